"""Checks and normal forms of input values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col, is_finite

LEAST_SPAN = 0.005
MOST_WAYPOINTS = 500


def json_safe(x) -> Column:
    """A double that JSON can hold: null where it is not finite."""
    x = col(x).cast("double")
    return F.when(is_finite(x), x)


def usable_segment(lon1, lat1, lon2, lat2) -> Column:
    """Whether a segment has finite ends that are two nodes at five decimals."""
    ends = [col(x).cast("double") for x in (lon1, lat1, lon2, lat2)]
    cell = [F.floor(x * 100000.0 + 0.5) for x in ends]
    finite = is_finite(ends[0] + ends[1] + ends[2] + ends[3])
    return F.coalesce(finite & ((cell[0] != cell[2]) | (cell[1] != cell[3])), F.lit(False))


def bounding_box(lon1, lat1, lon2, lat2, least_span: float = LEAST_SPAN) -> Column:
    """struct(west, south, east, north) in order and at least least_span wide; null for what is not finite or out of range."""
    lon1, lat1, lon2, lat2 = (col(x).cast("double") for x in (lon1, lat1, lon2, lat2))
    sound = is_finite(lon1 + lat1 + lon2 + lat2) & (F.greatest(F.abs(lon1), F.abs(lon2)) <= 180) & (F.greatest(F.abs(lat1), F.abs(lat2)) <= 90)

    def span(a: Column, b: Column) -> tuple[Column, Column]:
        low, high = F.least(a, b), F.greatest(a, b)
        narrow, middle = high - low < least_span, (low + high) / 2
        return F.when(narrow, middle - least_span / 2).otherwise(low), F.when(narrow, middle + least_span / 2).otherwise(high)

    (west, east), (south, north) = span(lon1, lon2), span(lat1, lat2)
    return F.when(sound, F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north")))


def waypoint_problem(points: Column) -> Column:
    """What is wrong with an array of struct(lon, lat); null for nothing."""
    bad = F.transform(points, lambda p, i: F.when(~is_finite(p["lon"] + p["lat"]) | (p["lon"] + p["lat"]).isNull(), F.format_string("waypoint %d is not finite", i + 1)).when((F.abs(p["lon"]) > 180) | (F.abs(p["lat"]) > 90), F.format_string("waypoint %d is out of range", i + 1)))
    count = F.coalesce(F.size(points), F.lit(0))
    return F.when(count < 1, "two waypoints are needed").when(count > MOST_WAYPOINTS, f"more than {MOST_WAYPOINTS} waypoints").otherwise(F.get(F.filter(bad, lambda x: x.isNotNull()), F.lit(0)))


def at_least_one(x, name: str) -> Column:
    """A non-negative number, as 1 at least; the query fails on others."""
    x = col(x).try_cast("double")
    return F.when(is_finite(x) & (x >= 0), F.greatest(F.lit(1.0), x)).otherwise(F.raise_error(F.lit(f"{name} has a negative or missing number")).cast("double"))
