"""What the time of day and extra layers add to the cost of an edge, and an edge's vector of objectives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kinematics
from .access import tag
from .geo import METRES_PER_DEGREE_LON
from .numbers import clamp, col, is_finite

COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def night_factor(profile, category, lit, rank, sidewalk) -> Column:
    """After dark walkers and cyclists prefer lit streets, and walkers sidewalks on main roads."""
    walks, rides = col(category) == "pedestrian", col(category) == "micromobility"
    light, side = tag(lit), tag(sidewalk)
    dark = F.when((light == "no") & (col(profile) != "night_walk"), F.when(walks, 1.6).otherwise(1.4)).when(light.isin("", "unknown"), 1.1).otherwise(1.0)
    bare = F.when(walks & (F.coalesce(col(rank), F.lit(4)) <= 3) & side.isin("no", "none"), 1.3).otherwise(1.0)
    return F.when(walks | rides, dark * bare).otherwise(1.0)


def heat_weight(weight, irradiance) -> Column:
    """The weight of heat by the sun's strength in W/m2: a quarter at night, 1.75 times at full sun."""
    return col(weight) * (0.25 + 1.5 * clamp(col(irradiance) / 1000.0, 0.0, 1.0))


def extra_factor(values: Column, weight: float) -> Column:
    """1 + weight x the mean of the layers that have a value (clamped to 0..1); 1 where none has."""
    known = F.filter(values, lambda x: x.isNotNull() & is_finite(x))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return F.when(F.size(known) > 0, 1.0 + clamp(mean, 0.0, 1.0) * weight).otherwise(1.0)


def edge_vector(profile, category, length_m, slope_pct, z1, z2, seconds, lst) -> Column:
    """struct(time_s, ascent_m, heat, kcal): without heat data no heat, and no energy for those who don't move themselves."""
    slope = col(slope_pct) / 100.0
    kcal = F.when(col(category) == "pedestrian", kinematics.minetti_kcal(slope, 70.0, length_m)).when(col(profile).isin("bicycle", "mtb"), kinematics.cycling_kcal(slope, 70.0, length_m)).otherwise(0.0)
    heat = F.coalesce(col(lst) * col(length_m) / 100.0, F.lit(0.0))
    return F.struct(col(seconds).alias("time_s"), F.greatest(F.lit(0.0), col(z2) - col(z1)).alias("ascent_m"), heat.alias("heat"), kcal.alias("kcal"))


def local_xy(lon, lat, lon0, lat0, metres_per_degree_lat: float) -> tuple[Column, Column]:
    """East and north metres in a flat frame at (lon0, lat0)."""
    return (col(lon) - col(lon0)) * METRES_PER_DEGREE_LON * F.cos(F.radians(col(lat0))), (col(lat) - col(lat0)) * metres_per_degree_lat


def slope_class(slope_pct) -> Column:
    s = F.abs(F.coalesce(col(slope_pct), F.lit(0.0)))
    return F.when(s < 3, "flat").when(s < 6, "gentle").when(s < 10, "moderate").otherwise("steep")


def compass_point(azimuth_deg) -> Column:
    at = F.floor(F.pmod(col(azimuth_deg), F.lit(360.0)) / 45.0 + 0.5).cast("int") % 8
    return F.element_at(F.array(*map(F.lit, COMPASS)), at + 1)


def clock(hour) -> Column:
    """HH:MM of a fractional hour."""
    total = F.floor(col(hour) * 60.0 + 0.5).cast("long")
    return F.format_string("%02d:%02d", F.floor(total / 60) % 24, total % 60)


def sun_direction(azimuth_deg, elevation_deg) -> tuple[Column, Column, Column]:
    """Unit vector towards the sun: east, up, south."""
    az, el = F.radians(col(azimuth_deg)), F.radians(col(elevation_deg))
    return F.sin(az) * F.cos(el), F.sin(el), -F.cos(az) * F.cos(el)
