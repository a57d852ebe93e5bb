"""The sun's position and shade of street canyons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp_or_null, col


def solar_position(lat, hour, day) -> Column:
    """struct(azimuth_deg, elevation_deg, irradiance): by declination and hour angle; below the horizon 180, 0, 0."""
    lat, hour, day = F.radians(col(lat)), col(hour), col(day)
    dec = F.radians(23.45 * F.sin(F.radians((360.0 / 365.0) * (284 + day))))
    angle = (hour - 12.0) * 15.0
    el = F.asin(clamp_or_null(F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(F.radians(angle)), -1, 1))
    az = F.degrees(F.acos(clamp_or_null((F.sin(dec) - F.sin(lat) * F.sin(el)) / F.greatest(F.lit(0.001), F.cos(lat) * F.cos(el)), -1, 1)))
    up = F.degrees(el) > 0
    return F.struct(
        F.when(~up, 180.0).when(angle > 0, 360.0 - az).otherwise(az).alias("azimuth_deg"),
        F.when(up, F.degrees(el)).otherwise(0.0).alias("elevation_deg"),
        F.when(up, 1000.0 * F.sin(el)).otherwise(0.0).alias("irradiance"),
    )


def street_shaded(lon1, lat1, lon2, lat2, azimuth_deg, elevation_deg, density: float = 0.6) -> Column:
    """Whether a street of this bearing is shaded by its buildings."""
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    street = F.atan2((lon2 - lon1) * F.cos(F.radians((lat1 + lat2) * 0.5)), lat2 - lat1)
    diff = F.abs(street - F.radians(col(azimuth_deg))) % (F.pi() / 2.0)
    reach = F.least(F.lit(1.0), 0.35 / F.greatest(F.lit(0.1), F.tan(F.radians(col(elevation_deg)))))
    return F.sin(diff) * density * reach > 0.45
