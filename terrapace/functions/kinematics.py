"""Speeds, forces and energies of walking, cycling, scooters and vehicles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp, col, finite

GRAVITY = 9.80665
JOULES_PER_KCAL = 4184.0

# Rolling resistance coefficients by surface.
ROLLING_RESISTANCE = {"asphalt": 0.004, "concrete": 0.005, "paved": 0.006, "paving_stones": 0.012, "cobblestone": 0.018, "gravel": 0.022, "compacted": 0.015, "dirt": 0.030, "ground": 0.035, "grass": 0.045, "sand": 0.080}
DEFAULT_ROLLING_RESISTANCE = 0.005

# Free-flow speed in km/h by road rank.
ROAD_SPEED = {1: 80.0, 2: 60.0, 3: 45.0, 4: 30.0, 5: 20.0}


def lookup(key: Column, table: dict, default) -> Column:
    """The table's value for a key, as one CASE that stays in generated code."""
    pairs = iter(table.items())
    k, v = next(pairs)
    out = F.when(key == F.lit(k), F.lit(v))
    for k, v in pairs:
        out = out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def tobler_speed(slope, base_kmh=5.0) -> Column:
    """Walking km/h on a slope fraction, scaled to a base speed."""
    s = clamp(finite(slope, 0), -0.6, 0.6)
    scale = F.greatest(F.lit(0.2), finite(base_kmh, 5, 0, strict=True) / 5.0)
    return clamp(6.0 * F.exp(-3.5 * F.abs(s + 0.05)) * scale, 0.5, 8.0)


def minetti_kcal(slope, mass_kg=70.0, distance_m=100.0) -> Column:
    """Energy of walking a distance on a slope fraction."""
    s = clamp(finite(slope, 0), -0.5, 0.5)
    per_kg_m = ((((280.5 * s - 58.7) * s - 76.8) * s + 51.9) * s + 19.6) * s + 2.5
    return F.greatest(F.lit(0.6), per_kg_m) * finite(mass_kg, 70, 0, strict=True) * finite(distance_m, 0, 0) / JOULES_PER_KCAL


def fatigue_decay(distance_m, climb_m) -> Column:
    score = finite(distance_m, 0, 0) / 1000.0 * 0.12 + finite(climb_m, 0, 0) / 100.0 * 0.25
    return clamp(F.exp(-0.35 * score), 0.45, 1.0)


def drag_watts(kmh, area_m2: float = 0.55, drag: float = 0.88, density: float = 1.225) -> Column:
    return 0.5 * density * drag * area_m2 * F.pow(finite(kmh, 0, 0) / 3.6, 3)


def rolling_force(mass_kg, slope, surface) -> Column:
    c = lookup(F.lower(surface if isinstance(surface, Column) else F.lit(surface)), ROLLING_RESISTANCE, DEFAULT_ROLLING_RESISTANCE)
    return c * finite(mass_kg, 70, 0, strict=True) * GRAVITY * F.cos(F.atan(F.abs(finite(slope, 0))))


def cyclist_speed(slope, base_kmh=18.0, watts=160.0, mass_kg=85.0, surface="asphalt") -> Column:
    """Coasting below -2 %, else what the power moves against gravity and rolling resistance."""
    s = clamp(finite(slope, 0), -0.25, 0.25)
    base, mass = finite(base_kmh, 18, 0, strict=True), finite(mass_kg, 85, 0, strict=True)
    force = F.greatest(F.lit(1.0), mass * GRAVITY * F.sin(F.atan(s)) + rolling_force(mass, s, surface))
    driven = F.greatest(F.lit(3.5), F.least(base * 1.5, finite(watts, 160, 0, strict=True) / force * 3.6))
    return F.when(s < -0.02, F.least(F.lit(45.0), base * (1.0 + F.abs(s) * 2.2))).otherwise(driven)


def cycling_kcal(slope, mass_kg=70.0, distance_m=0.0, bike_kg: float = 15.0, surface="asphalt", efficiency: float = 0.24) -> Column:
    s = clamp(finite(slope, 0), -0.3, 0.3)
    mass = finite(mass_kg, 70, 0, strict=True) + bike_kg
    kmh = cyclist_speed(s, mass_kg=mass, surface=surface)
    force = mass * GRAVITY * F.sin(F.atan(s)) + rolling_force(mass, s, surface) + drag_watts(kmh) / F.greatest(F.lit(0.1), kmh / 3.6)
    return F.greatest(F.lit(0.0), force) * finite(distance_m, 0, 0) / efficiency / JOULES_PER_KCAL


def scooter_speed(slope, base_kmh=20.0) -> Column:
    s, base = clamp(finite(slope, 0), -0.2, 0.2), finite(base_kmh, 20, 0, strict=True)
    uphill = F.greatest(F.lit(4.0), base * F.greatest(F.lit(0.25), 1.0 - F.pow(F.greatest(s, F.lit(0.0)) / 0.14, 1.5)))
    return F.when(s > 0.12, 4.0).when(s > 0, uphill).otherwise(F.least(F.lit(25.0), base * (1.0 + F.abs(s) * 0.5)))


def vehicle_speed(rank, lanes=2.0, slope_pct=0.0, base_kmh=50.0) -> Column:
    """Free-flow km/h by road rank, lanes and slope."""
    road = lookup(col(rank).cast("int"), ROAD_SPEED, 30.0) * (finite(base_kmh, 50, 0, strict=True) / 50.0)
    lanes = F.floor(finite(lanes, 2, 0, strict=True))
    wide = F.least(F.lit(10.0), F.greatest(F.lit(0.0), (lanes - 2) * 4.0))
    steep = F.least(F.lit(35.0), F.abs(finite(slope_pct, 0)))
    return F.greatest(F.lit(10.0), (road + wide) * F.greatest(F.lit(0.5), 1.0 - steep / 100.0 * 0.85))


def thermal_stress(temp_c, wind_ms=1.0, radiant_c=35.0) -> Column:
    """0 (none, at 18 degrees felt) to 1 (38 and more)."""
    t, mrt = finite(temp_c, 25), finite(radiant_c, 35)
    felt = t + 0.33 * (mrt - t) - 0.70 * F.sqrt(F.greatest(F.lit(0.1), finite(wind_ms, 1, 0)))
    return clamp((felt - 18.0) / 20.0, 0, 1)


def aspect_factor(aspect_deg, slope_pct, azimuth_deg=180.0, elevation_deg=55.0) -> Column:
    """Cosine of the sun's incidence on a slope, 0 to 1."""
    slope = F.atan(F.abs(finite(slope_pct, 0)) / 100.0)
    el = F.radians(finite(elevation_deg, 55))
    turn = F.radians(finite(azimuth_deg, 180)) - F.radians(finite(aspect_deg, 180))
    return clamp(F.sin(el) * F.cos(slope) + F.cos(el) * F.sin(slope) * F.cos(turn), 0, 1)
