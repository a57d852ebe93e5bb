"""Generalised cost and time of an edge for a profile, and turn delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kinematics as K
from .numbers import clamp, clamp_or_null, col, finite, is_finite


def edge_cost(length_m, slope_pct, steps, quality, rank, lst=None, green=None, limit_kmh=None) -> Column:
    """Cost of an edge by the columns of profiles(); null where it can't be passed.

    lst and green are 0 to 1, or null where there is no value: then their terms are neutral.
    """
    length = F.when(is_finite(col(length_m)) & (col(length_m) > 0), col(length_m)).otherwise(0.01)
    slope = F.abs(finite(slope_pct, 0))
    quality = clamp(finite(quality, 0.8), 0, 1)
    steep = F.greatest(F.lit(1.0), F.col("max_slope"))
    closed = (F.col("hard_slope").isNotNull() & (slope > F.greatest(steep, F.col("hard_slope")))) | ((slope > steep) & (F.col("category") != "pedestrian")) | (col(steps) & ~F.col("stairs"))
    by_slope = F.when(slope > steep, 1.0 + F.pow(slope / steep, 3) * 20.0 * F.col("w_slope")).otherwise(1.0 + slope / 10.0 * F.col("w_slope") * 1.5)
    by_stairs = F.when(col(steps), F.greatest(F.lit(1.0), F.col("stair_factor"))).otherwise(1.0)
    by_surface = F.when(quality < F.col("smoothness"), 1.0 + (F.col("smoothness") - quality) * 4.0).otherwise(1.0)
    heat = F.lit(0.0) if lst is None else F.coalesce(clamp_or_null(col(lst), 0, 1) * F.col("w_heat") * 1.8, F.lit(0.0))
    shade = F.lit(0.0) if green is None else F.coalesce(clamp_or_null(col(green), 0, 1) * F.col("w_green") * 0.4, F.lit(0.0))
    by_heat = F.greatest(F.lit(0.6), 1.0 + heat - shade)
    by_rank = F.coalesce(*(F.when(col(rank) == r, F.col(f"h{r}")) for r in range(1, 6)), F.lit(1.0))
    cost = length * by_slope * by_stairs * by_surface * by_heat * by_rank
    if limit_kmh is not None:
        free = K.vehicle_speed(rank, base_kmh=F.col("base_kmh"))
        limit = col(limit_kmh)
        cost = cost * F.when((F.col("category") == "vehicle") & (limit > 0) & (limit < free), free / limit).otherwise(1.0)
    return F.when(~closed, F.greatest(F.lit(0.01), cost))


def travel_seconds(length_m, slope_pct, rank, limit_kmh=None, lanes=2.0) -> Column:
    slope = finite(slope_pct, 0) / 100.0
    base = F.col("base_kmh")
    vehicle = K.vehicle_speed(rank, lanes, finite(slope_pct, 0), base)
    if limit_kmh is not None:
        vehicle = F.when(col(limit_kmh) > 0, F.least(vehicle, col(limit_kmh))).otherwise(vehicle)
    kmh = F.when(F.col("category") == "pedestrian", K.tobler_speed(slope, base)).when(F.col("profile").isin("bicycle", "mtb"), K.cyclist_speed(slope, base)).when(F.col("profile") == "scooter", K.scooter_speed(slope, base)).otherwise(vehicle)
    return finite(length_m, 0, 0) / F.greatest(F.lit(0.2), kmh / 3.6)


def turn_seconds(angle_deg, junction, dead_end, drive_left: bool = False) -> Column:
    """Seconds of a manoeuvre by the columns of turn_models(); null where it is forbidden."""
    angle = col(angle_deg)
    crossing = angle > 0 if drive_left else angle < 0
    delay = F.when(crossing, F.col("left_s")).otherwise(F.col("right_s"))
    return (
        F.when(F.abs(angle) >= 165, F.when(col(dead_end), F.col("dead_end_s")).otherwise(F.col("uturn_s")))
        .when(~col(junction) | (F.abs(angle) < 30), 0.0)
        .when(F.abs(angle) >= 120, delay + F.col("sharp_s"))
        .otherwise(delay)
    )
