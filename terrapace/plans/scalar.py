"""Queries of the scalar functions over rows of lineitem, with independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import access, geo, impedance, solar
from ..functions import kinematics as K
from ..functions.profiles import PROFILES, TURN_MODELS, profiles, turn_models, values_sql
from ..sources.fixtures import view, with_views

QUERIES, ORACLES = {}, {}


def scalar(name: str, sql: str, columns: Callable[[], dict[str, Column]]) -> None:
    """Registers k, n and the columns (rounded to 6 decimals) over samples."""

    def run(spark, sf_dir):
        return view(spark, sf_dir, "samples").select("k", "n", *(F.round(c, 6).alias(a) for a, c in columns().items()))

    QUERIES[name] = run
    ORACLES[name] = f"{with_views('samples')}\n{sql}"


def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    return f"CASE WHEN abs({a} - {c}) < 1e-11 AND abs({b} - {d}) < 1e-11 THEN 0e0 ELSE 2 * 6371008.8e0 * asin(sqrt(least(1e0, pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2)))) END"


C = F.col
scalar("k01_haversine", f"SELECT k, n, round(h, 6) AS d2, round(sqrt(h * h + (z2 - z1) * (z2 - z1)), 6) AS d3 FROM (SELECT *, {sql_haversine('lon1', 'lat1', 'lon2', 'lat2')} AS h FROM samples)", lambda: dict(d2=geo.haversine_2d("lon1", "lat1", "lon2", "lat2"), d3=geo.haversine_3d("lon1", "lat1", "z1", "lon2", "lat2", "z2")))
scalar("k02_tobler_speed", "SELECT k, n, round(greatest(0.5e0, least(8e0, 6e0 * exp(-3.5e0 * abs(greatest(-0.6e0, least(0.6e0, s)) + 0.05e0)) * greatest(0.2e0, kmh / 5e0))), 6) AS kmh FROM samples", lambda: dict(kmh=K.tobler_speed("s", "kmh")))
scalar("k03_minetti_energy", "SELECT k, n, round(greatest(0.6e0, 280.5e0 * pow(x, 5) - 58.7e0 * pow(x, 4) - 76.8e0 * pow(x, 3) + 51.9e0 * x * x + 19.6e0 * x + 2.5e0) * m * d / 4184e0, 6) AS kcal FROM (SELECT *, greatest(-0.5e0, least(0.5e0, s)) AS x FROM samples)", lambda: dict(kcal=K.minetti_kcal("s", "m", "d")))
scalar("k04_fatigue_decay", "SELECT k, n, round(greatest(0.45e0, least(1e0, exp(-0.35e0 * (d * 5 / 1000e0 * 0.12e0 + z2 / 100e0 * 0.25e0)))), 6) AS decay FROM samples", lambda: dict(decay=K.fatigue_decay(C("d") * 5, "z2")))
scalar("k05_aerodynamic_drag", "SELECT k, n, round(0.5e0 * 1.225e0 * 0.88e0 * 0.55e0 * pow(kmh / 3.6e0, 3), 6) AS watts FROM samples", lambda: dict(watts=K.drag_watts("kmh")))
_SURFACE = "CASE n WHEN 1 THEN 'Asphalt' WHEN 2 THEN 'gravel' WHEN 3 THEN 'sand' WHEN 4 THEN 'concrete' WHEN 5 THEN 'grass' WHEN 6 THEN 'cobblestone' ELSE 'lava' END"
_CRR = "CASE n WHEN 1 THEN 0.004e0 WHEN 2 THEN 0.022e0 WHEN 3 THEN 0.080e0 WHEN 4 THEN 0.005e0 WHEN 5 THEN 0.045e0 WHEN 6 THEN 0.018e0 ELSE 0.005e0 END"
scalar("k06_rolling_resistance", f"SELECT k, n, round({_CRR} * m * 9.80665e0 * cos(atan(abs(s))), 6) AS newton FROM samples", lambda: dict(newton=K.rolling_force("m", "s", F.expr(_SURFACE))))
_CYCLIST = "CASE WHEN {s} < -0.02e0 THEN least(45e0, {b} * (1 + abs({s}) * 2.2e0)) ELSE greatest(3.5e0, least({b} * 1.5e0, 160e0 / greatest(1e0, {m} * 9.80665e0 * sin(atan({s})) + {c} * {m} * 9.80665e0 * cos(atan(abs({s})))) * 3.6e0)) END"
scalar("k07_cyclist_speed", "SELECT k, n, round(" + _CYCLIST.format(s="x", b="18e0", m="m", c=_CRR) + ", 6) AS kmh FROM (SELECT *, greatest(-0.25e0, least(0.25e0, s)) AS x FROM samples)", lambda: dict(kmh=K.cyclist_speed("s", mass_kg="m", surface=F.expr(_SURFACE))))
scalar(
    "k08_cycling_energy",
    "SELECT k, n, round(greatest(0e0, w * 9.80665e0 * sin(atan(x)) + 0.004e0 * w * 9.80665e0 * cos(atan(abs(x))) + 0.5e0 * 1.225e0 * 0.88e0 * 0.55e0 * pow(v / 3.6e0, 3) / greatest(0.1e0, v / 3.6e0)) * d / 0.24e0 / 4184e0, 6) AS kcal FROM (SELECT *, "
    + _CYCLIST.format(s="y", b="18e0", m="w", c="0.004e0")
    + " AS v FROM (SELECT *, greatest(-0.3e0, least(0.3e0, s)) AS x, greatest(-0.25e0, least(0.25e0, s)) AS y, m + 15e0 AS w FROM samples))",
    lambda: dict(kcal=K.cycling_kcal("s", "m", "d")),
)
scalar("k09_scooter_speed", "SELECT k, n, round(CASE WHEN x > 0.12e0 THEN 4e0 WHEN x > 0 THEN greatest(4e0, 20e0 * greatest(0.25e0, 1 - pow(x / 0.14e0, 1.5e0))) ELSE least(25e0, 20e0 * (1 + abs(x) * 0.5e0)) END, 6) AS kmh FROM (SELECT *, greatest(-0.2e0, least(0.2e0, s)) AS x FROM samples)", lambda: dict(kmh=K.scooter_speed("s")))
_FREE = "greatest(10e0, (CASE {r} WHEN 1 THEN 80e0 WHEN 2 THEN 60e0 WHEN 3 THEN 45e0 WHEN 4 THEN 30e0 WHEN 5 THEN 20e0 ELSE 30e0 END * ({b} / 50e0) + least(10e0, greatest(0e0, ({l} - 2) * 4e0))) * greatest(0.5e0, 1 - least(35e0, abs({s})) / 100e0 * 0.85e0))"
scalar("k10_vehicle_speed", "SELECT k, n, round(" + _FREE.format(r="rank", b="kmh", l="CASE WHEN lanes > 0 THEN lanes ELSE 2 END", s="(s * 100)") + ", 6) AS kmh FROM samples", lambda: dict(kmh=K.vehicle_speed("rank", "lanes", C("s") * 100, "kmh")))
scalar("k11_solar_aspect", "SELECT k, n, round(greatest(0e0, least(1e0, sin(radians(55e0)) * cos(a) + cos(radians(55e0)) * sin(a) * cos(radians(180e0) - radians(kmh * 7)))), 6) AS factor FROM (SELECT *, atan(abs(s)) AS a FROM samples)", lambda: dict(factor=K.aspect_factor(C("kmh") * 7, C("s") * 100)))
scalar("k12_thermal_stress", "SELECT k, n, round(greatest(0e0, least(1e0, (t + 0.33e0 * (35e0 - t) - 0.70e0 * sqrt(greatest(0.1e0, m / 50e0)) - 18e0) / 20e0)), 6) AS stress FROM (SELECT *, kmh - 5 AS t FROM samples)", lambda: dict(stress=K.thermal_stress(C("kmh") - 5, C("m") / 50)))
scalar("k15_turn_angle", "SELECT k, n, round(CASE WHEN (x1 = 0 AND y1 = 0) OR (x2 = 0 AND y2 = 0) THEN 0e0 WHEN t > 180 THEN t - 360 WHEN t < -180 THEN t + 360 ELSE t END, 4) + 0e0 AS angle FROM (SELECT *, degrees(atan2(x2, y2) - atan2(x1, y1)) AS t FROM (SELECT *, (lon2 - lon1) * cos(radians(lat2)) AS x1, lat2 - lat1 AS y1, (27.12e0 - lon2) * cos(radians(lat2)) AS x2, 38.4305e0 - lat2 AS y2 FROM samples))", lambda: dict(angle=F.round(geo.bearing_change("lon1", "lat1", "lon2", "lat2", F.lit(27.12), F.lit(38.4305)), 4) + 0.0))
_SUN = "sin(radians(lat1)) * sin(dec) + cos(radians(lat1)) * cos(dec) * cos(radians(h))"
_SUN_CTE = f"(SELECT *, degrees(asin(greatest(-1e0, least(1e0, {_SUN})))) AS e FROM (SELECT *, radians(23.45e0 * sin(radians(360e0 / 365e0 * (284 + n * 50)))) AS dec, (kmh / 2 - 12e0) * 15e0 AS h FROM samples))"
_AZ = "degrees(acos(greatest(-1e0, least(1e0, (sin(dec) - sin(radians(lat1)) * sin(radians(e))) / greatest(0.001e0, cos(radians(lat1)) * cos(radians(e)))))))"


def _sun(field: str) -> Column:
    return solar.solar_position("lat1", C("kmh") / 2, C("n") * 50)[field]


scalar(
    "k17_solar_position",
    f"SELECT k, n, round(CASE WHEN e <= 0 THEN 180e0 WHEN h > 0 THEN 360e0 - {_AZ} ELSE {_AZ} END, 3) AS azimuth, round(CASE WHEN e > 0 THEN e ELSE 0e0 END, 6) AS elevation, round(CASE WHEN e > 0 THEN 1000e0 * sin(radians(e)) ELSE 0e0 END, 6) AS watts FROM {_SUN_CTE}",
    lambda: dict(azimuth=F.round(_sun("azimuth_deg"), 3), elevation=_sun("elevation_deg"), watts=_sun("irradiance")),
)
scalar(
    "k18_street_shade",
    "SELECT k, n, CASE WHEN sin(abs(atan2((lon2 - lon1) * cos(radians((lat1 + lat2) * 0.5e0)), lat2 - lat1) - radians(200e0)) % (pi() / 2)) * 0.9e0 * least(1e0, 0.35e0 / greatest(0.1e0, tan(radians(m / 3)))) > 0.45e0 THEN 1 ELSE 0 END AS shaded FROM samples",
    lambda: dict(shaded=solar.street_shaded("lon1", "lat1", "lon2", "lat2", 200.0, C("m") / 3, 0.9).cast("int")),
)
scalar("k20_gaussian_decay", "SELECT k, n, CASE WHEN d > 300 THEN 0e0 ELSE round(greatest(0e0, (exp(-0.5e0 * pow(d / 300e0, 2)) - exp(-0.5e0)) / (1 - exp(-0.5e0))), 6) END AS w FROM samples", lambda: dict(w=F.when(C("d") > 300, 0.0).otherwise(F.greatest(F.lit(0.0), (F.exp(-0.5 * F.pow(C("d") / 300.0, 2)) - F.exp(F.lit(-0.5))) / (1 - F.exp(F.lit(-0.5)))))))
scalar("k21_local_metres", "SELECT k, n, round(sqrt(pow((lon2 - lon1) * 111320e0 * cos(radians((lat1 + lat2) / 2)), 2) + pow((lat2 - lat1) * 110574e0, 2)), 6) AS metres FROM samples", lambda: dict(metres=geo.local_metres("lon1", "lat1", "lon2", "lat2")))
_KEYS = "CASE WHEN {a} <= 1 THEN 1.5e0 * pow({a}, 3) - 2.5e0 * {a} * {a} + 1 WHEN {a} < 2 THEN -0.5e0 * pow({a}, 3) + 2.5e0 * {a} * {a} - 4 * {a} + 2 ELSE 0e0 END"


def _cubic() -> Column:
    a = F.abs(C("s") * F.pi())
    return F.when(a <= 1, (1.5 * a - 2.5) * a * a + 1).when(a < 2, ((-0.5 * a + 2.5) * a - 4) * a + 2).otherwise(0.0)


scalar("k23_cubic_weight", "SELECT k, n, round(" + _KEYS.format(a="abs(s * pi())") + ", 6) AS w FROM samples", lambda: dict(w=_cubic()))
scalar("k24_slippy_tile", "SELECT k, n, floor((lon1 + 180) / 360 * 65536)::BIGINT AS x, floor((1 - ln(tan(radians(lat1)) + 1 / cos(radians(lat1))) / pi()) / 2 * 65536)::BIGINT AS y FROM samples", lambda: dict(x=geo.tile_x("lon1", 16), y=geo.tile_y("lat1", 16)))

# -- tags ---

_TAG = lambda *x: "CASE (k + n) % " + str(len(x)) + " " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(x[:-1])) + f" ELSE '{x[-1]}' END"
_MAXSPEED = _TAG("50", "30 mph", "none", "  70 km/h", "walk", "-5", "fast", "")
scalar("s05_maxspeed", f"SELECT k, n, round(CASE WHEN v > 0 THEN v END, 6) AS kmh FROM (SELECT k, n, try_cast(split_part(trim(t), ' ', 1) AS DOUBLE) * CASE WHEN t LIKE '%mph%' THEN 1.609344e0 ELSE 1 END AS v FROM (SELECT k, n, {_MAXSPEED} AS t FROM samples))", lambda: dict(kmh=access.speed_limit_kmh(F.expr(_MAXSPEED))))
_HIGHWAY = _TAG("motorway", "Primary_link", "tertiary", "living_street", "steps", "cycleway", "trunk", "service", "footway", "residential")
scalar("s06_highway_rank", f"SELECT k, n, CASE WHEN t IN ('motorway', 'trunk') THEN 1 WHEN t = 'primary_link' THEN 2 WHEN t = 'tertiary' THEN 3 WHEN t IN ('living_street', 'residential') THEN 4 ELSE 5 END AS rank FROM (SELECT k, n, lower({_HIGHWAY}) AS t FROM samples)", lambda: dict(rank=access.road_rank(F.expr(_HIGHWAY))))
_PAVING = _TAG(" Asphalt", "sett", "mud", "unheard", "", "concrete:plates", "wood")
scalar("f05_surface_quality", f"SELECT k, n, CASE t WHEN 'asphalt' THEN 1e0 WHEN 'sett' THEN 0.68e0 WHEN 'mud' THEN 0.08e0 WHEN '' THEN 0.65e0 WHEN 'concrete:plates' THEN 0.85e0 WHEN 'wood' THEN 0.72e0 ELSE 0.5e0 END AS quality FROM (SELECT k, n, lower(trim({_PAVING})) AS t FROM samples)", lambda: dict(quality=access.surface_quality(F.expr(_PAVING))))
scalar("f06_normalize_tag", f"SELECT k, n, length(lower(trim({_PAVING}))) AS size FROM samples", lambda: dict(size=F.length(access.tag(F.expr(_PAVING)))))
_CLOCK = "concat(cast(k % 30 as varchar(9)), ':', lpad(cast(n * 7 as varchar(9)), 2, '0'), ':05')"


def _clock(spark, sf_dir):
    parts = F.split(F.expr(_CLOCK.replace("varchar(9)", "string")), ":")
    seconds = parts[0].cast("long") * 3600 + parts[1].cast("long") * 60 + parts[2].cast("long")
    return view(spark, sf_dir, "samples").select("k", "n", seconds.alias("seconds"), F.format_string("%02d:%02d", F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60).alias("clock"))


QUERIES["s12_gtfs_time"] = _clock
ORACLES["s12_gtfs_time"] = f"{with_views('samples')} SELECT k, n, s AS seconds, lpad(((s // 3600) % 24)::VARCHAR, 2, '0') || ':' || lpad(((s // 60) % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT k, n, split_part(t, ':', 1)::BIGINT * 3600 + split_part(t, ':', 2)::BIGINT * 60 + split_part(t, ':', 3)::BIGINT AS s FROM (SELECT k, n, {_CLOCK} AS t FROM samples))"

# -- edges of the grid for every profile ---

_P_COLUMNS = "profile, category, base_kmh, max_slope, hard_slope, stairs, stair_factor, w_slope, w_heat, w_green, smoothness, h1, h2, h3, h4, h5"
_P = f"p({_P_COLUMNS}) AS (VALUES {values_sql(PROFILES)})"
_EDGE = "SELECT u, v, code, {len} AS length_m, 100 * (z2 - z1) / greatest(1e0, {len}) AS slope, code = 7 AS steps, 1 + code % 5 AS rank, (code % 10) / 10e0 AS quality, (v % 11) / 10e0 AS lst, (v % 7) / 6e0 AS green, CASE WHEN code % 3 = 0 THEN 30e0 END AS lim FROM grid_segments"


def edges(spark, sf_dir):
    return view(spark, sf_dir, "grid_segments").select(
        "u", "v", "code", geo.haversine_2d("lon1", "lat1", "lon2", "lat2").alias("length_m"), "z1", "z2",
    ).select("u", "v", "code", "length_m", (100 * (C("z2") - C("z1")) / F.greatest(F.lit(1.0), C("length_m"))).alias("slope"), (C("code") == 7).alias("steps"), (1 + C("code") % 5).alias("rank"), (C("code") % 10 / 10.0).alias("quality"), (C("v") % 11 / 10.0).alias("lst"), (C("v") % 7 / 6.0).alias("green"), F.when(C("code") % 3 == 0, 30.0).alias("lim"))


def _impedance(spark, sf_dir):
    cost = impedance.edge_cost("length_m", "slope", "steps", "quality", "rank", "lst", "green", "lim")
    return edges(spark, sf_dir).crossJoin(F.broadcast(profiles(spark))).select("u", "v", "profile", F.round(cost, 5).alias("cost"))


def _seconds_of(spark, sf_dir):
    seconds = impedance.travel_seconds("length_m", "slope", "rank", "lim")
    return edges(spark, sf_dir).crossJoin(F.broadcast(profiles(spark))).select("u", "v", "profile", F.round(seconds, 5).alias("seconds"))


_LEN = sql_haversine("lon1", "lat1", "lon2", "lat2")
_E = f"e AS ({_EDGE.format(len=_LEN)})"
QUERIES["k13_edge_impedance"] = _impedance
ORACLES["k13_edge_impedance"] = f"""{with_views('grid_segments')}, {_P}, {_E}
SELECT u, v, profile, round(CASE WHEN (hard_slope IS NOT NULL AND abs(slope) > greatest(max_slope, hard_slope)) OR (abs(slope) > max_slope AND category <> 'pedestrian') OR (steps AND NOT stairs) THEN NULL ELSE greatest(0.01e0, length_m
 * CASE WHEN abs(slope) > max_slope THEN 1 + 20 * w_slope * pow(abs(slope) / max_slope, 3) ELSE 1 + 1.5e0 * w_slope * abs(slope) / 10 END
 * CASE WHEN steps THEN greatest(1e0, stair_factor) ELSE 1 END * CASE WHEN quality < smoothness THEN 1 + 4 * (smoothness - quality) ELSE 1 END
 * greatest(0.6e0, 1 + 1.8e0 * w_heat * least(1e0, lst) - 0.4e0 * w_green * green)
 * CASE rank WHEN 1 THEN h1 WHEN 2 THEN h2 WHEN 3 THEN h3 WHEN 4 THEN h4 ELSE h5 END
 * CASE WHEN category = 'vehicle' AND lim < {_FREE.format(r='rank', b='base_kmh', l='2', s='0')} THEN {_FREE.format(r='rank', b='base_kmh', l='2', s='0')} / lim ELSE 1 END) END, 5) AS cost FROM e, p"""
_TOBLER = "greatest(0.5e0, least(8e0, 6e0 * exp(-3.5e0 * abs(greatest(-0.6e0, least(0.6e0, slope / 100)) + 0.05e0)) * greatest(0.2e0, base_kmh / 5e0)))"
QUERIES["k14_travel_time"] = _seconds_of
ORACLES["k14_travel_time"] = f"""{with_views('grid_segments')}, {_P}, {_E}
SELECT u, v, profile, round(length_m / greatest(0.2e0, CASE WHEN category = 'pedestrian' THEN {_TOBLER} WHEN profile IN ('bicycle', 'mtb') THEN {_CYCLIST.format(s='greatest(-0.25e0, least(0.25e0, slope / 100))', b='base_kmh', m='85e0', c='0.004e0')}
 WHEN profile = 'scooter' THEN CASE WHEN x > 0.12e0 THEN 4e0 WHEN x > 0 THEN greatest(4e0, base_kmh * greatest(0.25e0, 1 - pow(x / 0.14e0, 1.5e0))) ELSE least(25e0, base_kmh * (1 + abs(x) * 0.5e0)) END
 ELSE least({_FREE.format(r='rank', b='base_kmh', l='2', s='slope')}, coalesce(lim, 1e9)) END / 3.6e0), 5) AS seconds FROM (SELECT *, greatest(-0.2e0, least(0.2e0, slope / 100)) AS x FROM e), p"""

_T = f"t(profile, left_s, right_s, sharp_s, uturn_s, dead_end_s) AS (VALUES {values_sql(TURN_MODELS)})"
QUERIES["k16_turn_delay"] = lambda spark, sf_dir: view(spark, sf_dir, "samples").select("k", "n", (C("kmh") * 8 - 200).alias("angle")).crossJoin(F.broadcast(turn_models(spark))).select("k", "n", "profile", "angle", impedance.turn_seconds("angle", C("n") > 2, C("n") == 5).alias("delay"))
ORACLES["k16_turn_delay"] = f"{with_views('samples')}, {_T} SELECT k, n, profile, angle, CASE WHEN abs(angle) >= 165 THEN CASE WHEN n = 5 THEN dead_end_s ELSE uturn_s END WHEN n <= 2 OR abs(angle) < 30 THEN 0 ELSE CASE WHEN angle < 0 THEN left_s ELSE right_s END + CASE WHEN abs(angle) >= 120 THEN sharp_s ELSE 0 END END AS delay FROM (SELECT k, n, kmh * 8 - 200 AS angle FROM samples), t"

_TAGS = {
    "highway": _TAG("residential", "motorway", "footway", "steps", "cycleway", "", "trunk_link", "path"),
    "access": "CASE WHEN k % 11 = 0 THEN 'private' WHEN k % 11 = 1 THEN 'yes' ELSE '' END",
    "foot": "CASE WHEN k % 7 = 0 THEN 'no' WHEN k % 7 = 1 THEN 'designated' ELSE '' END",
    "bicycle": "CASE WHEN k % 5 = 0 THEN 'Yes' WHEN k % 5 = 1 THEN 'customers' ELSE '' END",
    "motor_vehicle": "CASE WHEN k % 6 = 0 THEN 'permissive' WHEN k % 6 = 1 THEN 'no' ELSE '' END",
    "lit": "CASE WHEN n % 2 = 0 THEN 'no' ELSE 'yes' END",
    "oneway_bicycle": "CASE WHEN k % 4 = 0 THEN 'no' WHEN k % 4 = 1 THEN 'yes' ELSE '' END",
    "oneway_foot": "CASE WHEN k % 9 = 0 THEN 'yes' ELSE '' END",
}
_FLAGS = {"oneway": "(k + n) % 3 = 0", "against_oneway": "(k + n) % 6 = 0", "reverse_of_two_way": "(k + n) % 3 = 1"}


def _access(spark, sf_dir):
    tagged = view(spark, sf_dir, "samples").select("k", "n", *(F.expr(x).alias(a) for a, x in (_TAGS | _FLAGS).items()))
    judged = tagged.select("k", "lit", F.explode(access.reasons({a: C(a) for a in (*_TAGS, *_FLAGS)})).alias("mode", "why"))
    by_mode = F.broadcast(profiles(spark).select("profile", access.mode_of("category").alias("mode")))
    decided = judged.join(by_mode, "mode").select("k", "profile", access.decision(C("why"), "profile", "lit").alias("x"))
    return decided.groupBy("profile", "x.allowed", "x.reason", "x.penalty").agg(F.count("*").alias("edges"), F.sum("k").alias("key_sum"))


QUERIES["f01_edge_access"] = _access
ORACLES["f01_edge_access"] = f"""{with_views('samples')}, {_P},
e AS (SELECT k, n, {', '.join(f'lower({x}) AS {a}' for a, x in _TAGS.items())}, {', '.join(f'{x} AS {a}' for a, x in _FLAGS.items())} FROM samples),
m AS (SELECT *, CASE mode WHEN 'foot' THEN foot WHEN 'bicycle' THEN bicycle ELSE motor_vehicle END AS modal, CASE WHEN highway = '' THEN 'unclassified' ELSE highway END AS hw FROM
 (SELECT e.*, profile, CASE category WHEN 'pedestrian' THEN 'foot' WHEN 'micromobility' THEN 'bicycle' ELSE 'motor_vehicle' END AS mode FROM e, p)),
r AS (SELECT *, CASE
 WHEN against_oneway AND (mode = 'motor_vehicle' OR (mode = 'bicycle' AND oneway_bicycle <> 'no')) THEN 'against one-way traffic'
 WHEN against_oneway AND mode = 'foot' AND oneway_foot = 'yes' THEN 'oneway:foot=yes'
 WHEN NOT against_oneway AND NOT oneway AND reverse_of_two_way AND mode = 'bicycle' AND oneway_bicycle = 'yes' THEN 'oneway:bicycle=yes'
 WHEN NOT against_oneway AND NOT oneway AND reverse_of_two_way AND mode = 'foot' AND oneway_foot = 'yes' THEN 'oneway:foot=yes'
 WHEN modal IN ('no', 'private', 'customers') THEN mode || '=' || modal
 WHEN modal = '' AND access = 'private' THEN 'access=private'
 WHEN modal IN ('yes', 'designated', 'permissive') THEN NULL
 WHEN mode = 'motor_vehicle' AND hw IN ('footway', 'steps', 'cycleway', 'path') THEN hw || ' excludes motor vehicles'
 WHEN mode <> 'motor_vehicle' AND hw IN ('motorway', 'trunk_link') THEN hw || ' excludes ' || mode
 WHEN mode = 'bicycle' AND hw = 'steps' THEN 'steps excludes bicycles' END AS why FROM m)
SELECT profile, why IS NULL AS allowed, CASE WHEN why IS NOT NULL THEN why WHEN profile = 'night_walk' AND lit = 'no' THEN 'unlit night-walk link' ELSE 'allowed' END AS reason,
 CASE WHEN why IS NULL AND profile = 'night_walk' AND lit = 'no' THEN 2e0 ELSE 1e0 END AS penalty, count(*) AS edges, sum(k)::BIGINT AS key_sum FROM r GROUP BY ALL"""
