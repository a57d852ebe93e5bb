"""Lower bounds of what a way costs, by distance alone: never more than the true cost, so searches can trust them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kinematics
from .geo import EARTH_RADIUS_M
from .impedance import travel_seconds
from .numbers import col
from .profiles import profiles

# What sampled seconds are multiplied by for speeds between the samples; the least factor of heat and green; the widest road.
SAFETY, THERMAL_FLOOR, MOST_LANES = 0.95, 0.6, 8.0
#: Shrinks flat distances below the great circle's.
FLATTER = 0.999


def planar_metres(lon1, lat1, lon2, lat2, highest_lat) -> Column:
    """Flat metres between two points, never more than the great circle's, for places that lie no farther from the equator than highest_lat."""
    degree = EARTH_RADIUS_M * 3.141592653589793 / 180 * FLATTER
    kx = degree * F.cos(F.radians(F.least(F.lit(89.9), F.abs(col(highest_lat)))))
    return F.hypot((col(lon1) - col(lon2)) * kx, (col(lat1) - col(lat2)) * degree)


def profile_bounds(spark: SparkSession) -> DataFrame:
    """(profile, seconds, kcal, cost) per metre at least: over slopes of -40 to 40 % (energy: -100 to 100 %) and all road ranks."""
    all_profiles = F.broadcast(profiles(spark))  # fifteen rows
    graded = spark.range(-20, 21).select((F.col("id") * 2.0).alias("slope_pct")).crossJoin(F.broadcast(spark.range(1, 6).select(F.col("id").cast("int").alias("rank")))).crossJoin(all_profiles)
    seconds = graded.withColumn("s", travel_seconds(F.lit(1000.0), "slope_pct", "rank", lanes=MOST_LANES) / 1000.0).groupBy("profile").agg((F.min("s") * SAFETY).alias("seconds"))
    slope = F.col("id") / 100.0
    kcal = F.when(F.col("category") == "pedestrian", kinematics.minetti_kcal(slope, 70.0, F.lit(1.0))).when(F.col("profile").isin("bicycle", "mtb"), kinematics.cycling_kcal(slope, 70.0, F.lit(1.0))).otherwise(0.0)
    energy = spark.range(-100, 101).crossJoin(all_profiles).withColumn("k", kcal).groupBy("profile").agg(F.greatest(F.lit(0.0), F.min("k")).alias("kcal"))
    cost = profiles(spark).select("profile", F.greatest(F.lit(1e-6), THERMAL_FLOOR * F.least(F.lit(1.0), *(F.col(f"h{r}") for r in range(1, 6)))).alias("cost"))
    return seconds.join(energy, "profile").join(cost, "profile")
