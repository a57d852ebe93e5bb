"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact size). Each source's budget first takes whole passes over
the source, then an even share of every size, and the rest of the budget is met by a bounded
knapsack over the sizes that are left: exactly, where the rest is below KNAPSACK_SIZES times the largest size or MOST_KNAPSACK. Which documents of one size are taken follows a seeded
hash: sizes are split into about sqrt(count) sub-buckets whose counts decide, so that no task ever
orders all documents of a common size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, WORD, Keyed, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
#: The knapsack meets budgets up to this many words, or times the largest size; larger remainders are first shortened to that, largest sizes first.
MOST_KNAPSACK = 1 << 16
KNAPSACK_SIZES = 8
#: Rows of a broadcast table, at most; larger ones are joined by a shuffle.
MOST_BROADCAST = 200_000


def target_sizes(totals: list[float], weights: list[float], share: float = 1.0, most: float = MOST_REPEATS) -> list[float]:
    """Budgets by weight of `share` of all sizes; none above most x its total, the excess reshared by weight."""
    left, open_ = share * float(sum(totals)), list(range(len(totals)))
    out = [0.0] * len(totals)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * totals[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most * float(totals[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, at most counts, so that their sum comes near the budget from below."""
    taken = np.zeros(len(sizes), dtype=np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return counts.astype(np.int64)
    limit = max(MOST_KNAPSACK, KNAPSACK_SIZES * int(sizes.max()))
    rest = budget
    if rest > limit:
        taken = counts * budget // total if float(counts.max()) * budget < 2**62 else np.array([int(c) * budget // total for c in counts], dtype=np.int64)
        rest -= int((sizes * taken).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= limit:
            break
        more = min(int(counts[i] - taken[i]), (rest - limit // 2) // int(sizes[i]) if sizes[i] else 0)
        if more > 0:
            taken[i] += more
            rest -= more * int(sizes[i])
    return taken + knapsack(sizes, counts - taken, rest)


def knapsack(sizes: np.ndarray, counts: np.ndarray, rest: int) -> np.ndarray:
    """How many of each size, at most counts, to take so that their sum is the largest that is not above rest.

    Reachable sums are the bits of an integer; each chunk of a size (1, 2, 4 ... of it) is one item, and items are added until rest is reached or
    none is left. Which items make the best sum is found by halves: a sum that both halves can share out, then each half by itself. So memory
    is a few bits for each word of rest, and nothing is rounded.
    """
    taken = np.zeros(len(sizes), dtype=np.int64)
    some = np.flatnonzero((counts > 0) & (sizes > 0) & (sizes <= rest))
    if not len(some):
        return taken
    unit = int(np.gcd.reduce(sizes[some]))
    most, reach, items = rest // unit, 1, []
    mask = (1 << (most + 1)) - 1
    for i in some[np.argsort(-sizes[some], kind="stable")].tolist():
        weight = int(sizes[i]) // unit
        room, step = min(int(counts[i]), most // weight), 1
        while room > 0 and not reach >> most & 1:
            step = min(step, room)
            items.append((i, step, step * weight))
            reach |= (reach << (step * weight)) & mask
            room -= step
            step *= 2
    parts = [(items, reach.bit_length() - 1)]
    while parts:
        own, total = parts.pop()
        if not total:
            continue
        if len(own) == 1:
            taken[own[0][0]] += own[0][1]
            continue
        halves = own[: len(own) // 2], own[len(own) // 2 :]
        shares = _sums(halves[0], total) & _mirrored(_sums(halves[1], total), total)
        first = (shares & -shares).bit_length() - 1
        parts += [(halves[0], first), (halves[1], total - first)]
    return taken


def _sums(items: list[tuple[int, int, int]], most: int) -> int:
    """The sums up to `most` that some of the items make, as bits."""
    reach, mask = 1, (1 << (most + 1)) - 1
    for _, _, weight in items:
        if weight <= most:
            reach |= (reach << weight) & mask
    return reach


_MIRROR = np.array([int(f"{b:08b}"[::-1], 2) for b in range(256)], dtype=np.uint8)


def _mirrored(bits: int, most: int) -> int:
    """Bit k of the result is bit most - k."""
    size = most // 8 + 1
    turned = _MIRROR[np.frombuffer(bits.to_bytes(size, "little"), dtype=np.uint8)[::-1]].tobytes()
    return int.from_bytes(turned, "little") >> (size * 8 - 1 - most)


def _fit_source(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("size")
    sizes, counts = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
    total, target = int((sizes * counts).sum()), float(frame["target"].iloc[0])
    whole = min(MOST_REPEATS, int(target // total)) if total else 0
    rest = int(round(target)) - whole * total if whole < MOST_REPEATS else 0
    return frame.assign(whole=whole, extra=fit(sizes, counts, rest))[["rank", "size", "n", "whole", "extra"]]


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, share: float = 1.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    size: the text's words (null: 0). Sources in the order of their code points, null last, weigh 5,
    2, 1, repeating; targets share the sum of all sizes and stop at 3 times their source's size, the
    excess reshared. taken is a multiple (0 to 3) of size. The choice depends on seed, ids, sources and texts
    alone, so reruns agree, also where ids repeat or are null: rows that are equal in all three are exchangeable. Texts without words have taken = 0. Repeated rows and rows with a null id are
    separate documents. An empty table gives an empty result. Other columns are ignored.

    The sources (one row each, with their totals) are assumed to fit in the driver; documents and sizes aren't.
    """
    keyed = Keyed(docs, id_col, [F.col(source_col).cast("string").alias("__source"), F.col(text_col).alias("__text")], ["__source", "__text"])
    return keyed.restore(choices(keyed.df, seed, share), {KEY: "doc_id"}).select("doc_id", "size", "source_size", "target", "taken")


def _lucky(keyed: DataFrame, seed: int) -> DataFrame:
    """keyed with __luck, a hash that orders documents of one size alike in every run.

    Keys that Keyed made up for repeated and null ids differ between runs. There luck comes from all columns, and a number for each
    of several equal rows: its place among those of its own partition, after those of earlier ones.
    """
    if "__id" not in keyed.columns:
        return keyed.withColumn("__luck", F.xxhash64(KEY, F.lit(seed)))
    rows = keyed.withColumns({"__same": F.xxhash64(*(c for c in keyed.columns if c != KEY)), "__part": F.shiftright(KEY, 33)})
    counts = rows.groupBy("__same", "__part").agg(F.count("*").alias("__n"))
    before = F.expr("coalesce(sum(__n) over (partition by __same order by __part rows between unbounded preceding and 1 preceding), 0)")
    place = F.expr(f"row_number() over (partition by __same, __part order by {KEY})")
    rows = rows.withColumn("__place", place).join(counts.select("__same", "__part", before.alias("__before")), ["__same", "__part"])
    return rows.withColumn("__luck", F.xxhash64("__same", F.col("__place") + F.col("__before"), F.lit(seed))).drop("__same", "__part", "__place", "__before")


def choices(keyed: DataFrame, seed: int = 7, share: float = 1.0) -> DataFrame:
    """As mix_sources(), for a frame with KEY, __source and __text."""
    spark = keyed.sparkSession
    slim = _lucky(keyed, seed).select(KEY, "__source", F.coalesce(F.regexp_count("__text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), "__luck")
    slim = stored(slim, "sizes")
    by_size = stored(slim.groupBy("__source", "size").agg(F.count("*").alias("n")), "size-counts")
    totals = [(r[0], int(r[1])) for r in by_size.groupBy("__source").agg(F.sum(F.col("size") * F.col("n"))).collect()]
    totals.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    targets = target_sizes([t for _, t in totals], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(totals))], share)
    rows = [(i, s, t, float(x)) for i, ((s, t), x) in enumerate(zip(totals, targets))]
    sources = spark.createDataFrame(rows, "rank long, __s string, source_size long, target double")
    if len(rows) <= MOST_BROADCAST:
        sources = F.broadcast(sources)
    known = by_size.join(sources, by_size["__source"].eqNullSafe(sources["__s"]))
    plan = known.select("rank", "size", "n", "target").groupBy("rank").applyInPandas(_fit_source, "rank long, size long, n long, whole long, extra long")
    plan = stored(plan.withColumn("cells", F.ceil(F.sqrt("n")).cast("long")), "plan")
    if plan.count() <= MOST_BROADCAST:
        plan = F.broadcast(plan)

    slim = slim.join(sources, slim["__source"].eqNullSafe(sources["__s"])).drop("__source", "__s")
    rows = slim.join(plan, ["rank", "size"]).withColumn("cell", F.pmod(F.xxhash64("__luck"), F.col("cells")))
    partial = rows.where("extra > 0 and extra < n")
    cells = partial.groupBy("rank", "size", "extra", "cell").agg(F.count("*").alias("m"))
    before = F.expr("coalesce(sum(m) over (partition by rank, size order by cell rows between unbounded preceding and 1 preceding), 0)")
    cut = cells.withColumn("before", before).select("rank", "size", "cell", F.greatest(F.lit(0), F.least(F.col("m"), F.col("extra") - F.col("before"))).alias("quota"))
    partial = partial.join(cut, ["rank", "size", "cell"])
    place = F.expr("row_number() over (partition by rank, size, cell order by __luck, __key)")
    partial = partial.withColumn("more", (place <= F.col("quota")).cast("long")).select(KEY, "size", "source_size", "target", "whole", "more")
    clear = rows.where("extra = 0 or extra = n").select(KEY, "size", "source_size", "target", "whole", F.when(F.col("extra") > 0, 1).otherwise(0).cast("long").alias("more"))
    return clear.union(partial).select(KEY, "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("more"))).alias("taken"))
