"""Accessibility by the enhanced two-step floating catchment area, and how evenly it is spread."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .network import stored
from .running import median, running_totals
from .spatial import within

DESERT = 0.0001


def gaussian_decay(distance: Column, radius_m: float) -> Column:
    """1 at no distance, 0 from the radius on."""
    end = math.exp(-0.5)
    return F.when(distance > radius_m, 0.0).otherwise(F.greatest(F.lit(0.0), (F.exp(-0.5 * F.pow(distance / radius_m, 2)) - end) / (1.0 - end)))


def access_scores(zones: DataFrame, facilities: DataFrame, radius_m: float = 1500.0) -> DataFrame:
    """zones(zone_id, lon, lat, population) with score; facilities(facility_id, lon, lat, capacity)."""
    # All zones of a place have one score, and all facilities of a place one demand; so pairs are of places, however many rows share them.
    homes = zones.groupBy("lon", "lat").agg(F.sum("population").alias("population"))
    sites = facilities.groupBy("lon", "lat").agg(F.sum("capacity").alias("capacity"))
    near = stored(within(homes, sites, radius_m).withColumn("w", gaussian_decay(F.col("distance_m"), radius_m)).select("lon", "lat", "population", "lon_r", "lat_r", "capacity", "w"), "near")
    demand = near.groupBy("lon_r", "lat_r").agg(F.sum(F.col("population") * F.col("w")).alias("demand"), F.first("capacity").alias("c"))
    ratio = demand.select("lon_r", "lat_r", F.when(F.col("demand") > 0, F.col("c") / F.col("demand")).otherwise(0.0).alias("ratio"))
    score = near.join(ratio, ["lon_r", "lat_r"]).groupBy("lon", "lat").agg(F.sum(F.col("ratio") * F.col("w")).alias("score"))
    return zones.join(score, ["lon", "lat"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _ranked(scores: DataFrame) -> DataFrame:
    """scores with running shares of people and access, in the order of the score."""
    # Quantiles, ranges, totals and rows all read the scores, so they are joined once and stored.
    scores = stored(scores.withColumn("__order", F.round("score", 9)), "scores")
    scores = stored(running_totals(scores, ["__order", "zone_id"], {"cum_pop": "population", "cum_acc": "population * score", "position": "1"}), "ranks")
    total = scores.agg(F.sum("population").alias("pop"), F.sum(F.col("population") * F.col("score")).alias("acc"), F.count("*").alias("n")).crossJoin(F.broadcast(median(scores, "score", "position")))  # one row each
    total = total.select("n", "median", F.when(F.col("pop") == 0, 1.0).otherwise(F.col("pop")).alias("pop"), F.when(F.col("acc") == 0, 1.0).otherwise(F.col("acc")).alias("acc"))
    return scores.crossJoin(F.broadcast(total)).withColumns({"p": F.col("cum_pop") / F.col("pop"), "a": F.col("cum_acc") / F.col("acc")})  # one row


def scorecard(scores: DataFrame) -> DataFrame:
    """A row per zone: score, percentile of people at or below it, tier."""
    s, m = F.col("score"), F.col("median")
    tier = F.when(s <= DESERT, "Transit Desert").when(s < m * 0.5, "Underserved").when(s < m * 1.5, "Adequate").otherwise("Mobility Oasis")
    return _ranked(scores).select("zone_id", "score", (F.col("p") * 100).alias("pct_rank"), tier.alias("tier"))


def inequality(scores: DataFrame) -> DataFrame:
    """One row: gini, theil, palma, mean and median of access."""
    r = _ranked(scores)
    mine = F.col("population") * F.col("score")
    # The trapezoid (p - p_before)(a + a_before) needs no neighbour: both steps are the row's own shares.
    step = F.col("population") / F.col("pop") * (2 * F.col("a") - mine / F.col("acc"))
    ratio = F.col("score") / (F.col("acc") / F.col("pop"))
    theil = F.when(F.col("score") > 0, F.col("population") / F.col("pop") * ratio * F.log(ratio)).otherwise(0.0)
    out = r.agg(F.sum(step).alias("g"), F.sum(theil).alias("t"), F.sum(F.when(F.col("p") <= 0.4, mine)).alias("low"), F.sum(F.when(F.col("p") >= 0.9, mine)).alias("top"), F.first(F.col("acc") / F.col("pop")).alias("mean"), F.first("median").alias("median"))
    palma = F.when(F.coalesce("low", F.lit(0.0)) > 0, F.coalesce("top", F.lit(0.0)) / F.greatest(F.lit(0.001), F.col("low"))).otherwise(1.0)
    return out.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("g"))).alias("gini"), F.greatest(F.lit(0.0), F.col("t")).alias("theil"), palma.alias("palma"), "mean", "median")


def lorenz(scores: DataFrame) -> DataFrame:
    """About twenty points (pop_share, acc_share) of the curve, from the origin to its end."""
    every = F.greatest(F.lit(1), F.floor(F.col("n") / 20))
    points = _ranked(scores).where(((F.col("position") - 1) % every == 0) | (F.col("position") == F.col("n"))).select(F.round("p", 4).alias("pop_share"), F.round("a", 4).alias("acc_share"))
    return points.union(points.sparkSession.range(1).select(F.lit(0.0), F.lit(0.0)))


def gini(values: DataFrame, x: str) -> DataFrame:
    """Plain Gini index of non-negative values."""
    r = running_totals(values.select(F.col(x).alias("__x")).withColumn("__id", F.monotonically_increasing_id()), ["__x", "__id"], {"i": "1"})
    out = r.agg(F.sum(F.col("i") * F.col("__x")).alias("ix"), F.sum("__x").alias("s"), F.count("*").alias("n"))
    return out.select(F.when(F.col("s") > 0, 2 * F.col("ix") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini"))
