"""Choosing among alternatives: dominance, archetypes, weights, and tidy parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least spans of the four objectives when they are scaled.
LEAST_SPAN = {"time_s": 1.0, "ascent_m": 1.0, "heat": 0.1, "kcal": 1.0}


def dominates(a: dict[str, Column], b: dict[str, Column], eps: float = 0.0) -> Column:
    """a is nowhere worse than b by more than a share of eps; without eps it must be better somewhere."""
    whole = None
    strict = None
    for k in a:
        no_worse, better = a[k] <= b[k] * (1 + eps), a[k] < b[k]
        whole = no_worse if whole is None else whole & no_worse
        strict = better if strict is None else strict | better
    return whole if eps > 0 else whole & strict


def skyline(solutions: DataFrame, group: str, key: str, objectives: list[str]) -> DataFrame:
    """Solutions of each group (one query's alternatives, few by nature) that no other of the group dominates."""
    other = solutions.select(F.col(group).alias("__g"), *(F.col(c).alias(f"__{c}") for c in objectives))
    worse = dominates({c: F.col(f"__{c}") for c in objectives}, {c: F.col(c) for c in objectives})
    return solutions.join(other, (F.col(group) == F.col("__g")) & worse, "left_anti")


def archetypes(solutions: DataFrame, group: str, key: str) -> DataFrame:
    """Per group the best by each objective of LEAST_SPAN, and the knee: the least distance to the ideal, in scaled objectives."""
    w = Window.partitionBy(group)
    scaled = {c: (F.col(c) - F.min(c).over(w)) / F.greatest(F.lit(span), F.max(c).over(w) - F.min(c).over(w)) for c, span in LEAST_SPAN.items()}
    far = F.sqrt(sum((x * x for x in scaled.values()), F.lit(0.0)))
    rows = solutions.withColumn("__far", F.round(far, 9))
    return rows.groupBy(group).agg(*(F.min_by(key, F.struct(c, key)).alias(f"best_{c}") for c in LEAST_SPAN), F.min_by(key, F.struct("__far", key)).alias("knee"), F.round(F.min("__far"), 4).alias("knee_distance"))


def intervals(minutes: Column, most: float = 1440.0, count: int = 12) -> Column:
    """Positive intervals up to `most`, at three decimals, each once, ascending, the first `count`."""
    ok = F.filter(minutes, lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0) & (x <= most))
    return F.slice(F.array_sort(F.array_distinct(F.transform(ok, lambda x: F.round(x, 3)))), 1, count)


def normalised_weights(weights: list[str], fallback: dict[str, float]) -> list[Column]:
    """Each weight's share of their sum; the fallback's where the sum is not positive."""
    clean = {c: F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))) for c in weights}
    total = sum(clean.values(), F.lit(0.0))
    return [F.when(total > 0, x / total).otherwise(F.lit(fallback[c])).alias(c) for c, x in clean.items()]


def tick_step(span: Column, count: int = 5) -> Column:
    """The least of 1, 2, 5, 10 times a power of ten that is at least the span cut in `count`."""
    raw = span / float(count)
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    lead = raw / power
    return power * F.when(lead <= 1, 1.0).when(lead <= 2, 2.0).when(lead <= 5, 5.0).otherwise(10.0)
