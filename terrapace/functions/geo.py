"""Distances, bearings and local projections on WGS84 coordinates (degrees)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col, finite, is_finite

EARTH_RADIUS_M = 6371008.8
METRES_PER_DEGREE_LON = 111320.0
METRES_PER_DEGREE_LAT = 110574.0


def haversine_2d(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres; 0 for missing or non-finite coordinates and for points within 1e-11 degrees."""
    lon1, lat1, lon2, lat2 = (col(x).cast("double") for x in (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) * 0.5), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) * 0.5), 2)
    known = is_finite(lon1 + lat1 + lon2 + lat2)
    same = (F.abs(lon1 - lon2) < 1e-11) & (F.abs(lat1 - lat2) < 1e-11)
    return F.when(known & ~same, 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))).otherwise(0.0)


def haversine_3d(lon1, lat1, z1, lon2, lat2, z2) -> Column:
    return F.hypot(haversine_2d(lon1, lat1, lon2, lat2), finite(z2, 0) - finite(z1, 0))


def local_metres(lon1, lat1, lon2, lat2) -> Column:
    """Flat distance in a frame at the mean latitude."""
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    dx = (lon2 - lon1) * METRES_PER_DEGREE_LON * F.cos(F.radians((lat1 + lat2) / 2.0))
    return F.hypot(dx, (lat2 - lat1) * METRES_PER_DEGREE_LAT)


def bearing_change(ax, ay, bx, by, cx, cy) -> Column:
    """Degrees by which the direction changes at b on the way a, b, c; positive to the right, 0 where a leg has no length."""
    ax, ay, bx, by, cx, cy = map(col, (ax, ay, bx, by, cx, cy))
    k = F.cos(F.radians(by))
    x1, y1, x2, y2 = (bx - ax) * k, by - ay, (cx - bx) * k, cy - by
    diff = F.degrees(F.atan2(x2, y2) - F.atan2(x1, y1))
    folded = F.when(diff > 180, diff - 360).when(diff < -180, diff + 360).otherwise(diff)
    return F.when(((x1 == 0) & (y1 == 0)) | ((x2 == 0) & (y2 == 0)), 0.0).otherwise(folded)


def node_cell(degrees) -> Column:
    """Identity of a coordinate at five decimals, as an integer."""
    return F.floor(col(degrees) * 100000.0 + 0.5).cast("long")


def tile_x(lon, zoom: int) -> Column:
    return F.floor((col(lon) + 180.0) / 360.0 * float(2**zoom)).cast("long")


def tile_y(lat, zoom: int) -> Column:
    r = F.radians(col(lat))
    return F.floor((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / F.pi()) / 2.0 * float(2**zoom)).cast("long")
