"""The mobility profiles and turn models, as small static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Key, category, km/h, greatest slope %, hard limit % (or none), stairs allowed, stair factor, sensitivity to
# slope and heat, preference for green, smoothness wanted, factors for road ranks 1 to 5.
PROFILES = (
    ("adult", "pedestrian", 5.0, 25.0, None, True, 1.2, 1.0, 0.4, 0.4, 0.2, 2.5, 1.8, 1.2, 1.0, 0.9),
    ("senior", "pedestrian", 3.2, 10.0, None, True, 8.0, 2.8, 0.85, 0.9, 0.6, 4.0, 2.5, 1.5, 1.0, 0.8),
    ("child", "pedestrian", 3.5, 12.0, None, True, 2.0, 1.5, 0.7, 0.8, 0.4, 8.0, 4.0, 1.8, 1.0, 0.7),
    ("stroller", "pedestrian", 4.0, 6.0, 10.0, False, 100.0, 3.0, 0.6, 0.7, 0.8, 3.5, 2.0, 1.3, 1.0, 0.9),
    ("wheelchair", "pedestrian", 3.8, 5.0, 8.33, False, 1000.0, 4.0, 0.6, 0.6, 0.9, 3.0, 1.8, 1.2, 1.0, 0.9),
    ("jogger", "pedestrian", 9.5, 20.0, None, True, 1.5, 0.8, 0.6, 0.85, 0.3, 6.0, 3.0, 1.5, 1.0, 0.7),
    ("bicycle", "micromobility", 18.0, 15.0, None, False, 50.0, 1.8, 0.3, 0.5, 0.6, 10.0, 1.6, 1.1, 0.9, 1.0),
    ("mtb", "micromobility", 16.0, 28.0, None, True, 5.0, 0.9, 0.2, 0.8, 0.1, 15.0, 2.0, 1.2, 0.9, 0.6),
    ("scooter", "micromobility", 20.0, 12.0, None, False, 100.0, 2.5, 0.3, 0.3, 0.85, 10.0, 2.0, 1.2, 0.9, 1.0),
    ("car", "vehicle", 50.0, 25.0, None, False, 1000.0, 0.5, 0.0, 0.0, 0.5, 0.6, 0.8, 1.0, 1.5, 2.5),
    ("delivery_van", "vehicle", 42.0, 18.0, None, False, 1000.0, 0.9, 0.0, 0.0, 0.6, 0.7, 0.8, 1.0, 1.2, 2.0),
    ("truck", "vehicle", 40.0, 7.0, None, False, 1000.0, 3.5, 0.0, 0.0, 0.7, 0.5, 0.7, 1.2, 3.0, 10.0),
    ("paramedic", "vehicle", 65.0, 22.0, None, False, 1000.0, 0.4, 0.0, 0.0, 0.4, 0.5, 0.6, 0.8, 1.0, 1.5),
    ("sightseer", "pedestrian", 4.2, 20.0, None, True, 1.0, 0.5, 0.4, 1.0, 0.3, 8.0, 4.0, 2.0, 1.0, 0.6),
    ("night_walk", "pedestrian", 4.8, 15.0, None, True, 3.0, 1.2, 0.0, 0.2, 0.7, 1.2, 1.0, 1.0, 1.4, 4.0),
)
PROFILE_COLUMNS = "profile string, category string, base_kmh double, max_slope double, hard_slope double, stairs boolean, stair_factor double, w_slope double, w_heat double, w_green double, smoothness double, h1 double, h2 double, h3 double, h4 double, h5 double"

# Key, seconds for left, right, sharp extra, U-turn, U-turn at a dead end; none where forbidden.
TURN_MODELS = (
    ("car", 6.0, 2.0, 4.0, None, 30.0),
    ("paramedic", 4.0, 1.5, 3.0, 20.0, 15.0),
    ("delivery_van", 8.0, 3.0, 8.0, None, 45.0),
    ("truck", 12.0, 6.0, None, None, 90.0),
    ("bicycle", 3.0, 1.0, 2.0, 10.0, 6.0),
    ("mtb", 3.0, 1.0, 2.0, 10.0, 6.0),
    ("scooter", 3.0, 1.0, 2.0, 10.0, 6.0),
    ("wheelchair", 0.0, 0.0, 3.0, 6.0, 6.0),
    ("stroller", 0.0, 0.0, 2.0, 4.0, 4.0),
)
TURN_COLUMNS = "profile string, left_s double, right_s double, sharp_s double, uturn_s double, dead_end_s double"


def profiles(spark: SparkSession) -> DataFrame:
    """Fifteen rows, small enough to broadcast always."""
    return spark.createDataFrame(list(PROFILES), PROFILE_COLUMNS)


def with_profile(df: DataFrame, key: str) -> DataFrame:
    """df with the columns of one profile as constants, so that what the profile rules out is folded away before code is made."""
    row = next(r for r in PROFILES if r[0] == key)
    names = [(x.split(" ")[0], x.split(" ")[1]) for x in PROFILE_COLUMNS.split(", ")]
    return df.withColumns({name: F.lit(value).cast(kind) for (name, kind), value in zip(names, row)})


def turn_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TURN_MODELS), TURN_COLUMNS)


def values_sql(rows: tuple) -> str:
    """The rows as the text of an SQL VALUES list."""
    one = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
