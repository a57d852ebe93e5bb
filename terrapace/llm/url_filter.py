"""URL rules by a blocked Bloom filter and an exact hash join.

Each rule's canonical form (host and path) sets bits within one 256-bit block of a Bloom filter,
so that a lookup reads one block. Every distinct url gives the canonical forms that could match
it (its host and parent domains, with the path's beginnings of the lengths that occur in rules);
those that pass the filter go to an exact hash join with the rules, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules per 256-bit block; and the most blocks (of 40 bytes) that are broadcast, beyond which the filter is joined by a shuffle.
RULES_PER_BLOCK = 16
MOST_BROADCAST_BLOCKS = 1 << 16
BITS_PER_RULE = 5


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null and urls without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hash(seed: int) -> Column:
    return F.xxhash64("rule_host", "rule_path", F.lit(seed))


def _places(blocks: int) -> list[Column]:
    """The block of a canonical form, and the bits it sets in the block's four words (`__h` chooses them, a byte each)."""
    bits = [f"(shiftright(__h, {8 * i}) & 255)" for i in range(BITS_PER_RULE)]
    word = lambda w: " | ".join(f"(case when shiftright({b}, 6) = {w} then shiftleft(1L, cast({b} & 63 as int)) else 0L end)" for b in bits)
    return [F.pmod(_hash(2), F.lit(blocks)).alias("block"), *(F.expr(word(w)).alias(f"w{w}") for w in range(4))]


def bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """(block, f0..f3): the filter's blocks that have a bit set."""
    placed = rules.withColumn("__h", _hash(1)).select(*_places(blocks))
    return placed.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"f{i}") for i in range(4)))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict (columns of these names in pages are replaced; all others are kept, whatever their names).

    rules(rule_host, rule_path, verdict): a rule fits its host and all subdomains when the url's
    path starts with its path; the longest rule wins, then an allowing one. Without a fitting rule
    the verdict is `default` and rule is null. Null urls and urls without :// have an empty host and
    path and fit no rule. Repeated urls are judged once; every row of pages is returned, so repeated
    and null ids need no care. Empty tables give empty results.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("rule_verdict"))
    counts = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    blocks = max(1, -(-counts["n"] // RULES_PER_BLOCK))
    lengths = F.array(*(F.lit(int(n)) for n in sorted(counts["lengths"]))) if counts["lengths"] else F.array().cast("array<int>")
    urls = pages.select(F.col(url_col).alias("__url")).where(F.col("__url").isNotNull()).distinct().select("__url", host_of(F.col("__url")).alias("__host"), path_of(F.col("__url")).alias("__path"))
    labels = F.split("__host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = (
        urls.where("__host <> ''")
        .select("__url", F.explode(hosts).alias("rule_host"), "__path")
        .select("__url", "rule_host", "__path", F.explode(lengths).alias("__n"))
        .where("__n <= length(__path)")
        .select("__url", "rule_host", F.expr("substring(__path, 1, __n)").alias("rule_path"))
    )
    filters = bloom(rules, blocks)
    if blocks <= MOST_BROADCAST_BLOCKS:
        filters = F.broadcast(filters)
    placed = tried.withColumn("__h", _hash(1)).select("__url", "rule_host", "rule_path", *_places(blocks))
    hit = placed.join(filters, "block")
    for i in range(4):
        hit = hit.where(F.col(f"w{i}").bitwiseAND(F.col(f"f{i}")) == F.col(f"w{i}"))
    found = hit.select("__url", "rule_host", "rule_path").join(rules, ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    best = found.groupBy("__url").agg(F.max(F.struct(F.length(rule).alias("n"), F.when(F.col("rule_verdict") == "allow", 1).otherwise(0).alias("a"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("__best")).select("__url", F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("__verdict"))
    rows = pages.select(F.struct("*").alias("__page"), F.col(url_col).alias("__of"))
    judged = rows.join(best, F.col("__of") == F.col("__url"), "left")
    return judged.select("__page.*", host_of(F.col("__of")).alias("host"), path_of(F.col("__of")).alias("path"), "rule", F.coalesce("__verdict", F.lit(default)).alias("verdict"))
