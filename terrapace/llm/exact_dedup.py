"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Pass one maps each normalised text's hash to one cell in each of two rows of a counting Bloom
filter, counts the cells (combined map-side) and keeps, as 64-bit words, the bits of the cells
that were hit twice. Pass two looks both cells of every row up in those words, which have a fixed
largest size and are broadcast; more rows than one filter serves are cut into slices by their hash, each with a
filter of its own, over the stored digests of that slice alone. A row with a cell that was hit once is certainly unlike all others
and passes straight through; only the rest shuffle, as (digest, key, length) without their text,
to be grouped by SHA-256.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, SPACE, Keyed, fresh_path, stored

#: Cells in each row of the filter for each document, and the most cells of one filter, which bound its broadcast to 2 x 2**19 words.
CELLS_PER_DOCUMENT = 12
MOST_CELLS = 1 << 25


def _cells(n: int) -> int:
    return max(1 << 12, n * CELLS_PER_DOCUMENT)


def _known(rows: DataFrame, keys: DataFrame) -> DataFrame | None:
    """rows with `__again` where their KEY may be among those of keys, by a plain Bloom filter; None for more keys than one filter serves."""
    hashes = keys.select(F.xxhash64(KEY).alias("__h"))
    cells = _cells(hashes.count())
    if cells > MOST_CELLS:
        return None
    return maybe_repeated(rows.withColumn("__h", F.xxhash64(KEY)), stored(repeated_bits(hashes, cells, 1), "bits"), cells)


def possible_members(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows whose KEY may be among those of keys: all that are, and few others. Beyond MOST_CELLS / 12 keys all rows are, as scans for slice after slice would cost more than the shuffle that they spare."""
    marked = _known(rows, keys)
    return rows if marked is None else marked.where("__again").select(rows.columns)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def repeated_bits(hashes: DataFrame, cells: int, least: int = 2) -> DataFrame:
    """(row, word, bits) of the counting filter over __h: bits of the cells that `least` or more hashes hit."""
    hit = hashes.select(F.explode(F.array(*(F.struct(F.lit(r).alias("row"), _cell(r, cells).alias("cell")) for r in (0, 1)))).alias("x")).select("x.*")
    twice = hit.groupBy("row", "cell").count().where(f"count >= {least}")
    word = F.expr("shiftright(cell, 6)")
    return twice.groupBy("row", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits"))


def _cell(row: int, cells: int) -> Column:
    return F.pmod(F.xxhash64("__h", F.lit(row)), F.lit(cells))


def maybe_repeated(rows: DataFrame, bits: DataFrame, cells: int) -> DataFrame:
    """rows with `__again`: both cells of their hash were hit twice. The filter is broadcast: at most 2 x MOST_CELLS / 64 words."""
    for r in (0, 1):
        part = F.broadcast(bits.where(F.col("row") == r).select(F.col("word").alias(f"__w{r}"), F.col("bits").alias(f"__b{r}")))
        rows = rows.withColumn(f"__c{r}", _cell(r, cells)).withColumn(f"__w{r}", F.expr(f"shiftright(__c{r}, 6)")).join(part, f"__w{r}", "left")
    hit = lambda r: F.expr(f"coalesce(shiftright(__b{r}, cast(__c{r} & 63 as int)) & 1, 0) = 1")
    return rows.withColumn("__again", hit(0) & hit(1)).drop("__w0", "__w1", "__b0", "__b1", "__c0", "__c1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after white space is deleted; null counts as empty. The row
    with the most code points in its original text stays, then the smallest id. Repeated rows
    (also of one id, or with a null id) are separate members of a group: exactly one row of a
    group has kept = true. Empty and very long texts are texts like any other; an empty table
    gives an empty result; other columns are ignored.
    """
    keyed = Keyed(docs, id_col, [F.col(text_col).alias("__text")], ["__text"])
    return keyed.restore(decisions(keyed.df), {KEY: "doc_id", "__keep": "keep_id"}).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def decisions(keyed: DataFrame) -> DataFrame:
    """As exact_dedup(), for a frame with KEY and __text; columns KEY, __keep, group_size, kept, text_sha256.

    Texts are read once, for digests; those of rows that may be repeated are grouped, and the stored groups let
    Spark split the join of a very large one.
    """
    rows = keyed.select(KEY, F.sha2(normalised(F.col("__text")), 256).alias("text_sha256"), F.length(F.coalesce("__text", F.lit(""))).alias("__n"))
    slices = -(-_cells(keyed.count()) // MOST_CELLS)
    if slices == 1:
        digests = stored(rows, "digests").withColumn("__slice", F.lit(0))
    else:
        path = fresh_path(keyed.sparkSession, "digests")
        rows = rows.withColumn("__slice", F.pmod(F.xxhash64("text_sha256", F.lit(7)), F.lit(slices)).cast("int"))
        rows.write.option("compression", "zstd").partitionBy("__slice").parquet(path)
        digests = keyed.sparkSession.read.schema(rows.schema).parquet(path)
    digests = digests.withColumn("__h", F.xxhash64("text_sha256"))
    marked = reduce(DataFrame.union, [_marked(digests.where(F.col("__slice") == k).drop("__slice")) for k in range(slices)])
    again = marked.where("__again").select(KEY, "text_sha256", "__n")
    groups = stored(again.groupBy("text_sha256").agg(F.max_by(KEY, F.struct("__n", -F.col(KEY))).alias("__keep"), F.count("*").alias("group_size")), "groups")
    alone = marked.where("not __again").select(KEY, F.col(KEY).alias("__keep"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    met = again.join(groups, "text_sha256").select(KEY, "__keep", "group_size", (F.col(KEY) == F.col("__keep")).alias("kept"), "text_sha256")
    return alone.union(met)


def _marked(rows: DataFrame) -> DataFrame:
    """rows with `__again`, by the counting filter of their own hashes."""
    cells = _cells(rows.count())
    return maybe_repeated(rows, stored(repeated_bits(rows.select("__h"), cells), "bits"), cells)


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows whose KEY is not among dropped's. Only rows that a Bloom filter of dropped lets through shuffle; the rest pass straight through.

    Beyond MOST_CELLS / 12 keys the join is a plain one, see possible_members().
    """
    dropped = stored(dropped.select(KEY), "dropped")
    marked = _known(rows, dropped)
    if marked is None:
        return rows.join(dropped, KEY, "left_anti").select(rows.columns)
    return marked.where("not __again").select(rows.columns).union(marked.where("__again").join(dropped, KEY, "left_anti").select(rows.columns))


def drop_copies(keyed: DataFrame) -> DataFrame:
    """The rows that stay of a frame with KEY and __text, with all their columns."""
    return without(keyed, decisions(keyed).where("not kept"))
