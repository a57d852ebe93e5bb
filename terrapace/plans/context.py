"""Queries of validation, of the context of an edge, of cue sheets and of terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import context, validation
from ..functions.profiles import TURN_MODELS, profiles, turn_models
from ..operators import cues, raster, terrain
from ..sources.fixtures import view, with_views
from .scalar import _P, scalar, sql_haversine
from .scalar import ORACLES as _SCALAR_ORACLES
from .scalar import QUERIES as _SCALAR_QUERIES

C = F.col
_nan = lambda c: F.when(C("n") == 3, float("nan")).when(C("n") == 4, float("inf")).otherwise(C(c))
_before = set(_SCALAR_QUERIES)
scalar("f12_json_safe", "SELECT k, n, round(CASE WHEN n IN (3, 4) THEN NULL ELSE z2 END, 6) AS z FROM samples", lambda: dict(z=validation.json_safe(_nan("z2"))))
scalar("k22_local_xy", "SELECT k, n, round((lon1 - 27.1e0) * 111320e0 * cos(radians(38.4e0)), 6) AS x, round((lat1 - 38.4e0) * 110540e0, 6) AS y FROM samples", lambda: (lambda xy: dict(x=xy[0], y=xy[1]))(context.local_xy("lon1", "lat1", F.lit(27.1), F.lit(38.4), 110540.0)))
scalar("g04_heat_weight", "SELECT k, n, round(s * (0.25e0 + 1.5e0 * greatest(0e0, least(1e0, d * 3 / 1000))), 6) AS w FROM samples", lambda: dict(w=context.heat_weight("s", C("d") * 3)))
scalar("a23_extra_factor", "SELECT k, n, round(CASE WHEN n = 1 THEN 1e0 ELSE 1 + 0.3e0 * greatest(0e0, least(1e0, CASE WHEN n IN (3, 4) THEN s ELSE (s + m / 100) / 2 END)) END, 6) AS f FROM samples", lambda: dict(f=context.extra_factor(F.when(C("n") == 1, F.array().cast("array<double>")).otherwise(F.array(C("s"), F.when(C("n") == 3, float("nan")).when(C("n") == 4, None).otherwise(C("m") / 100), F.lit(None).cast("double"))), 0.3)))
scalar("k29_sun_direction", "SELECT k, n, round(sin(radians(kmh * 7)) * cos(radians(d / 10)), 6) + 0e0 AS east, round(sin(radians(d / 10)), 6) AS up, round(-cos(radians(kmh * 7)) * cos(radians(d / 10)), 6) + 0e0 AS south FROM samples", lambda: dict(zip(("east", "up", "south"), (c + 0.0 for c in context.sun_direction(C("kmh") * 7, C("d") / 10)))))
QUERIES = {k: _SCALAR_QUERIES[k] for k in _SCALAR_QUERIES if k not in _before}
ORACLES = {k: _SCALAR_ORACLES[k] for k in QUERIES}

QUERIES["k29_compass_clock"] = lambda spark, sf_dir: view(spark, sf_dir, "samples").select("k", "n", context.compass_point(C("kmh") * 17.3 - 200).alias("point"), context.clock(C("kmh") / 2.1).alias("clock"))
ORACLES["k29_compass_clock"] = with_views("samples") + " SELECT k, n, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[1 + (floor(fmod(fmod(kmh * 17.3e0 - 200, 360) + 360, 360) / 45 + 0.5e0)::INT % 8)] AS point, printf('%02d:%02d', floor(t / 60e0)::BIGINT % 24, t % 60) AS clock FROM (SELECT *, floor(kmh / 2.1e0 * 60 + 0.5e0)::BIGINT AS t FROM samples)"
QUERIES["k28_slope_class"] = lambda spark, sf_dir: view(spark, sf_dir, "samples").select("k", "n", context.slope_class(C("s") * 40).alias("class"))
ORACLES["k28_slope_class"] = with_views("samples") + " SELECT k, n, CASE WHEN abs(s * 40) < 3 THEN 'flat' WHEN abs(s * 40) < 6 THEN 'gentle' WHEN abs(s * 40) < 10 THEN 'moderate' ELSE 'steep' END AS class FROM samples"
QUERIES["f07_usable_segments"] = lambda spark, sf_dir: view(spark, sf_dir, "samples").where(validation.usable_segment(_nan("lon1"), "lat1", F.when(C("n") == 1, C("lon1") + 1e-7).otherwise(C("lon2")), F.when(C("n") == 1, C("lat1")).otherwise(C("lat2")))).select("k", "n", "lon1")
ORACLES["f07_usable_segments"] = with_views("samples") + " SELECT k, n, lon1 FROM samples WHERE n NOT IN (3, 4) AND CASE WHEN n = 1 THEN floor(lon1 * 100000e0 + 0.5e0) <> floor((lon1 + 1e-7) * 100000e0 + 0.5e0) ELSE floor(lon1 * 100000e0 + 0.5e0) <> floor(lon2 * 100000e0 + 0.5e0) OR floor(lat1 * 100000e0 + 0.5e0) <> floor(lat2 * 100000e0 + 0.5e0) END"
QUERIES["f09_bounding_box"] = lambda spark, sf_dir: view(spark, sf_dir, "samples").select("k", "n", validation.bounding_box(_nan("lon1"), "lat1", "lon2", F.when(C("n") == 2, 95.0).otherwise(C("lat2"))).alias("b")).select("k", "n", *(F.round(f"b.{c}", 6).alias(c) for c in ("west", "south", "east", "north")))
ORACLES["f09_bounding_box"] = with_views("samples") + " SELECT k, n, " + ", ".join(f"round(CASE WHEN n IN (2, 3, 4) THEN NULL WHEN abs({a} - {b}) < 0.005e0 THEN ({a} + {b}) / 2 {sign} 0.0025e0 ELSE {f}({a}, {b}) END, 6) AS {name}" for name, a, b, f, sign in (("west", "lon1", "lon2", "least", "-"), ("south", "lat1", "lat2", "least", "-"), ("east", "lon1", "lon2", "greatest", "+"), ("north", "lat1", "lat2", "greatest", "+"))) + " FROM samples"


def _waypoints(spark, sf_dir):
    points = view(spark, sf_dir, "samples").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", _nan("lon1").alias("lon"), (C("lat1") * F.when(C("n") == 6, 3).otherwise(1)).alias("lat")))).alias("p"))
    return points.select("k", validation.waypoint_problem(C("p")).alias("problem"))


QUERIES["f09_waypoints"] = _waypoints
ORACLES["f09_waypoints"] = with_views("samples") + ", w AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY n, CASE n WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE lon1 END, lat1) AS i FROM samples) SELECT k, arg_min(CASE WHEN n IN (3, 4) THEN 'waypoint ' || i || ' is not finite' WHEN n = 6 THEN 'waypoint ' || i || ' is out of range' END, i) AS problem FROM w GROUP BY 1"
QUERIES["f13_at_least_one"] = lambda spark, sf_dir: view(spark, sf_dir, "facilities").select("facility_id", validation.at_least_one(C("capacity") / 3000, "capacity").alias("capacity"))
ORACLES["f13_at_least_one"] = with_views("facilities") + " SELECT facility_id, greatest(1e0, capacity / 3000) AS capacity FROM facilities"

_TAGS = {"lit": "CASE code % 3 WHEN 0 THEN 'No' WHEN 1 THEN '' ELSE 'yes' END", "sidewalk": "CASE code % 4 WHEN 0 THEN 'none' WHEN 1 THEN ' no' ELSE 'both' END"}


def _night(spark, sf_dir):
    tagged = view(spark, sf_dir, "grid_segments").select("u", "v", (1 + C("code") % 5).alias("rank"), *(F.expr(x).alias(a) for a, x in _TAGS.items()))
    return tagged.crossJoin(F.broadcast(profiles(spark))).select("u", "v", "profile", context.night_factor("profile", "category", "lit", "rank", "sidewalk").alias("factor"))


QUERIES["g03_night_factor"] = _night
ORACLES["g03_night_factor"] = f"""{with_views('grid_segments')}, {_P}, t AS (SELECT u, v, 1 + code % 5 AS rank, {', '.join(f'trim(lower({x})) AS {a}' for a, x in _TAGS.items())} FROM grid_segments)
SELECT u, v, profile, CASE category WHEN 'vehicle' THEN 1e0 ELSE CASE WHEN lit = 'no' AND profile <> 'night_walk' THEN CASE category WHEN 'pedestrian' THEN 1.6e0 ELSE 1.4e0 END WHEN lit = '' THEN 1.1e0 ELSE 1e0 END * CASE WHEN category = 'pedestrian' AND rank <= 3 AND sidewalk IN ('no', 'none') THEN 1.3e0 ELSE 1e0 END END AS factor FROM t, p"""


def _vector(spark, sf_dir):
    edges = view(spark, sf_dir, "samples").crossJoin(F.broadcast(profiles(spark).where("profile in ('adult', 'bicycle', 'car')")))
    v = context.edge_vector("profile", "category", "d", C("s") * 100, "z1", "z2", C("d") / C("base_kmh") * 3.6, F.when(C("n") != 2, C("m") / 100))
    return edges.select("k", "n", "profile", v.alias("v")).select("k", "n", "profile", *(F.round(f"v.{c}", 5).alias(c) for c in ("time_s", "ascent_m", "heat", "kcal")))


QUERIES["g16_edge_vector"] = _vector

ORACLES["g16_edge_vector"] = f"""{with_views('samples')}, {_P}, a AS (SELECT *, greatest(-0.5e0, least(0.5e0, s)) AS x5, greatest(-0.3e0, least(0.3e0, s)) AS x3, greatest(-0.25e0, least(0.25e0, s)) AS y FROM samples),
b AS (SELECT *, CASE WHEN y < -0.02e0 THEN least(45e0, 18e0 * (1 + abs(y) * 2.2e0)) ELSE greatest(3.5e0, least(27e0, 160e0 / greatest(1e0, 85e0 * 9.80665e0 * sin(atan(y)) + 0.004e0 * 85e0 * 9.80665e0 * cos(atan(abs(y)))) * 3.6e0)) END AS ride FROM a)
SELECT k, n, profile, round(d / base_kmh * 3.6e0, 5) AS time_s, round(greatest(0e0, z2 - z1), 5) AS ascent_m, round(CASE WHEN n <> 2 THEN m / 100 * d / 100 ELSE 0 END, 5) AS heat,
 round(CASE profile WHEN 'adult' THEN greatest(0.6e0, 280.5e0 * pow(x5, 5) - 58.7e0 * pow(x5, 4) - 76.8e0 * pow(x5, 3) + 51.9e0 * x5 * x5 + 19.6e0 * x5 + 2.5e0) * 70 * d / 4184e0 WHEN 'bicycle' THEN greatest(0e0, 85e0 * 9.80665e0 * sin(atan(x3)) + 0.004e0 * 85e0 * 9.80665e0 * cos(atan(abs(x3))) + 0.5e0 * 1.225e0 * 0.88e0 * 0.55e0 * pow(ride / 3.6e0, 3) / greatest(0.1e0, ride / 3.6e0)) * d / 0.24e0 / 4184e0 ELSE 0e0 END, 5) AS kcal FROM b, p WHERE profile IN ('adult', 'bicycle', 'car')"""
QUERIES["a04_thermal_comfort"] = lambda spark, sf_dir: view(spark, sf_dir, "samples").groupBy("k").agg(terrain.thermal_comfort(F.when(C("n") % 3 != 0, C("m") / 120), "d").alias("c")).select("k", F.round("c", 6).alias("comfort"))
ORACLES["a04_thermal_comfort"] = with_views("samples") + " SELECT k, CASE WHEN count_if(n % 3 <> 0) > 0 THEN round(greatest(0e0, least(1e0, 1 - sum(m / 120 * d) FILTER (n % 3 <> 0) / sum(d) FILTER (n % 3 <> 0))), 6) END AS comfort FROM samples GROUP BY 1"

# -- cue sheets


def _routes(spark, sf_dir):
    return view(spark, sf_dir, "routes")


QUERIES["p05_cue_sheet"] = lambda spark, sf_dir: cues.cue_sheet(_routes(spark, sf_dir)).select("route_id", "step", "direction", F.round("distance_m", 3).alias("distance_m"), F.round("climb_m", 3).alias("climb_m"), F.round("slope_pct", 3).alias("slope_pct"), F.round("before_m", 3).alias("before_m"))
ORACLES["p05_cue_sheet"] = f"""{with_views('routes')},
r AS (SELECT *, lag(lon) OVER w AS lon_p, lag(lat) OVER w AS lat_p, lag(z) OVER w AS z_p, lead(lon) OVER w AS lon_n, lead(lat) OVER w AS lat_n, count(*) OVER (PARTITION BY route_id) AS n FROM routes WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
t AS (SELECT *, fmod(fmod(fmod(degrees(atan2(lon_n - lon, lat_n - lat)) + 360, 360) - fmod(degrees(atan2(lon - lon_p, lat - lat_p)) + 360, 360) + 180 + 720, 360), 360) - 180 AS turn, {sql_haversine('lon_p', 'lat_p', 'lon', 'lat')} AS d, z - z_p AS dz FROM r WHERE seq > 1),
m AS (SELECT route_id, seq, n, d, dz, CASE WHEN lon_n IS NULL THEN 'arrive' WHEN abs(turn) < 15 THEN 'straight' WHEN turn > 45 THEN 'right' WHEN turn > 15 THEN 'slight_right' WHEN turn < -45 THEN 'left' ELSE 'slight_left' END AS direction FROM t),
f AS (SELECT route_id, seq, d AS acc, dz AS climb, direction, direction <> 'straight' OR d > 400 AS ends FROM m WHERE seq = 2
 UNION ALL SELECT m.route_id, m.seq, CASE WHEN f.ends THEN 0 ELSE f.acc END + m.d, CASE WHEN f.ends THEN 0 ELSE f.climb END + m.dz, m.direction, m.direction <> 'straight' OR CASE WHEN f.ends THEN 0 ELSE f.acc END + m.d > 400 FROM f JOIN m ON m.route_id = f.route_id AND m.seq = f.seq + 1),
c AS (SELECT route_id, 1 AS seq, 'depart' AS direction, 0e0 AS d, 0e0 AS dz FROM m WHERE seq = 2 UNION ALL SELECT route_id, seq, direction, acc, climb FROM f WHERE ends)
SELECT route_id, row_number() OVER w AS step, direction, round(d, 3) AS distance_m, round(dz, 3) AS climb_m, round(CASE WHEN direction IN ('depart', 'arrive') THEN 0 ELSE 100 * dz / greatest(0.1e0, d) END, 3) AS slope_pct, round(sum(d) OVER w - d, 3) AS before_m FROM c WINDOW w AS (PARTITION BY route_id ORDER BY seq)"""
QUERIES["p10_turn_delays"] = lambda spark, sf_dir: cues.turn_delays(_routes(spark, sf_dir).crossJoin(F.broadcast(turn_models(spark).where("profile = 'bicycle'").drop("profile")))).select("route_id", F.round("delay_s", 3).alias("delay_s"))
_B = next(r for r in TURN_MODELS if r[0] == "bicycle")
ORACLES["p10_turn_delays"] = f"""{with_views('routes')}, r AS (SELECT *, cos(radians(lat)) AS c, lag(lon) OVER w AS lon_p, lag(lat) OVER w AS lat_p, lead(lon) OVER w AS lon_n, lead(lat) OVER w AS lat_n FROM routes WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
t AS (SELECT *, CASE WHEN (lon = lon_p AND lat = lat_p) OR (lon = lon_n AND lat = lat_n) THEN 0 ELSE degrees(atan2((lon_n - lon) * c, lat_n - lat) - atan2((lon - lon_p) * c, lat - lat_p)) END AS x FROM r),
f AS (SELECT route_id, lon_p IS NOT NULL AND lon_n IS NOT NULL AS inner_point, CASE WHEN x > 180 THEN x - 360 WHEN x < -180 THEN x + 360 ELSE x END AS a FROM t)
SELECT route_id, round(coalesce(sum(CASE WHEN abs(a) >= 165 THEN {_B[4]} WHEN abs(a) < 30 THEN 0 ELSE CASE WHEN a < 0 THEN {_B[1]} ELSE {_B[2]} END + CASE WHEN abs(a) >= 120 THEN {_B[3]} ELSE 0 END END) FILTER (inner_point), 0), 3)::DOUBLE AS delay_s FROM f GROUP BY 1"""
QUERIES["u05_joined_legs"] = lambda spark, sf_dir: cues.joined_legs(_routes(spark, sf_dir).select(F.expr("route_id div 4").alias("trip_id"), (C("route_id") % 4).alias("leg"), "seq", "lon", "lat")).select("trip_id", "leg", "seq", C("at").cast("long").alias("at"))
ORACLES["u05_joined_legs"] = with_views("routes") + " SELECT trip_id, leg, seq, row_number() OVER (PARTITION BY trip_id ORDER BY leg, seq) - 1 AS at FROM (SELECT route_id // 4 AS trip_id, route_id % 4 AS leg, seq FROM routes) WHERE leg = 0 OR seq > 1"


def _shares(spark, sf_dir):
    points = view(spark, sf_dir, "tracks").select(C("track_id").alias("route_id"), "seq", "lon", F.round("lat", 4).alias("lat"))
    ids = points.select("route_id").distinct()
    pairs = ids.select(C("route_id").alias("primary"), (C("route_id") + 40).alias("alternative"))
    return terrain.route_share(pairs, points).select("primary", "alternative", F.round("share", 6).alias("share"))


QUERIES["a36_route_share"] = _shares
ORACLES["a36_route_share"] = f"""{with_views('tracks')}, e AS (SELECT * FROM (SELECT track_id AS r, lon, round(lat, 4) AS lat, lead(lon) OVER w AS lon2, lead(round(lat, 4)) OVER w AS lat2 FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY seq)) WHERE lon2 IS NOT NULL),
k AS (SELECT r, [floor(lon * 100000e0 + 0.5e0)::BIGINT, floor(lat * 100000e0 + 0.5e0)::BIGINT] AS a, [floor(lon2 * 100000e0 + 0.5e0)::BIGINT, floor(lat2 * 100000e0 + 0.5e0)::BIGINT] AS b, {sql_haversine('lon', 'lat', 'lon2', 'lat2')} AS d FROM e),
s AS (SELECT r, least(a, b) AS p, greatest(a, b) AS q, d FROM k), u AS (SELECT DISTINCT r, p, q, TRUE AS again FROM s), ids AS (SELECT DISTINCT track_id AS t FROM tracks)
SELECT t AS primary, t + 40 AS alternative, round(sum(CASE WHEN again THEN d ELSE 0 END) / nullif(sum(d), 0), 6) AS share FROM ids JOIN s ON s.r = t + 40 LEFT JOIN u ON u.r = t AND u.p = s.p AND u.q = s.q GROUP BY 1, 2"""

# -- terrain

ORIGIN, STEP = (27.10, 38.40), (0.0005, 0.0005)


def _idw(spark, sf_dir):
    known = view(spark, sf_dir, "grid_nodes").select("lon", "lat", "z")
    return terrain.inverse_distance(view(spark, sf_dir, "zones").select("zone_id", "lon", "lat"), "zone_id", known, 120.0).select("zone_id", F.round("z", 5).alias("z"))


QUERIES["e03_inverse_distance"] = _idw
ORACLES["e03_inverse_distance"] = f"{with_views('zones', 'grid_nodes')} SELECT zone_id, round(coalesce(min(z) FILTER (d < 1e-6), sum(z / (d * d)) FILTER (d >= 1e-6) / sum(1 / (d * d)) FILTER (d >= 1e-6)), 5) AS z FROM (SELECT zone_id, n.z, {sql_haversine('a.lon', 'a.lat', 'n.lon', 'n.lat')} AS d FROM zones a JOIN grid_nodes n ON abs(n.lat - a.lat) < 0.002) WHERE d <= 120 GROUP BY 1"


def _bilinear(spark, sf_dir):
    cells = view(spark, sf_dir, "grid_nodes").select("i", "j", C("dem").alias("value"))
    side = cells.agg(F.max("i") + 1).first()[0]
    return terrain.bilinear(view(spark, sf_dir, "zones"), ["zone_id"], cells, ORIGIN, STEP, (side, side)).select("zone_id", F.round("z", 5).alias("z"))


QUERIES["k26_bilinear"] = _bilinear
ORACLES["k26_bilinear"] = with_views("zones", "grid_nodes") + """, f AS (SELECT zone_id, greatest(0e0, least(s - 1e0, (lon - 27.1e0) / 0.0005e0)) AS x, greatest(0e0, least(s - 1e0, (lat - 38.4e0) / 0.0005e0)) AS y, s FROM zones, side),
g AS (SELECT *, floor(x)::BIGINT AS i0, floor(y)::BIGINT AS j0, x - floor(x) AS tx, y - floor(y) AS ty FROM f)
SELECT zone_id, round(a.dem * (1 - tx) * (1 - ty) + b.dem * tx * (1 - ty) + c.dem * (1 - tx) * ty + d.dem * tx * ty, 5) AS z FROM g JOIN grid_nodes a ON a.i = i0 AND a.j = j0 JOIN grid_nodes b ON b.i = least(i0 + 1, s - 1) AND b.j = j0 JOIN grid_nodes c ON c.i = i0 AND c.j = least(j0 + 1, s - 1) JOIN grid_nodes d ON d.i = least(i0 + 1, s - 1) AND d.j = least(j0 + 1, s - 1)"""
QUERIES["a37_filled_grid"] = lambda spark, sf_dir: terrain.filled(view(spark, sf_dir, "grid_nodes").select("i", "j", F.when((C("i") % 9 > 3) | (C("j") % 8 > 2), C("dem")).alias("value"))).select("i", "j", F.round("value", 4).alias("value"))
ORACLES["a37_filled_grid"] = with_views("grid_nodes") + ", r0 AS (SELECT i, j, CASE WHEN i % 9 > 3 OR j % 8 > 2 THEN dem END AS v FROM grid_nodes)" + "".join(f", r{k + 1} AS (SELECT a.i, a.j, coalesce(any_value(a.v), avg(b.v)) AS v FROM r{k} a LEFT JOIN r{k} b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 AND b.i BETWEEN a.i - 1 AND a.i + 1 AND a.v IS NULL GROUP BY 1, 2)" for k in range(3)) + " SELECT i, j, round(v, 4) AS value FROM r3"


def _judged(spark, sf_dir):
    """Three parts make the upper triangle of a matrix."""
    places = F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in ((0, 1), (0, 2), (1, 2))))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr("p_partkey div 3").alias("matrix"), F.element_at(places, (C("p_partkey") % 3 + 1).cast("int")).alias("at"), (C("p_size") / 4.0).alias("value"))
    return rows.select("matrix", "at.i", "at.j", "value")


def _judgments(spark, sf_dir):
    return terrain.pairwise(_judged(spark, sf_dir), "matrix").select("matrix", "i", "j", F.round("value", 6).alias("value"))


QUERIES["a34_pairwise"] = _judgments
ORACLES["a34_pairwise"] = "WITH r AS (SELECT p_partkey // 3 AS matrix, CASE p_partkey % 3 WHEN 2 THEN 1 ELSE 0 END AS i, CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 2 END AS j, greatest(1 / 9e0, least(9e0, p_size / 4e0)) AS v FROM part) SELECT matrix, i, j, round(v, 6) AS value FROM r UNION ALL SELECT matrix, j, i, round(1 / v, 6) FROM r UNION ALL SELECT matrix, x, x, 1e0 FROM (SELECT DISTINCT matrix, unnest([i, j]) AS x FROM r)"


def _priorities(spark, sf_dir):
    """Weights of the matrices of a34."""
    found = raster.ahp(terrain.pairwise(_judged(spark, sf_dir), "matrix"), "matrix")
    return found.select("matrix", "i", *(F.round(c, 6).alias(c) for c in ("weight", "lambda_max", "ci")), F.round("cr", 5).alias("cr"), "consistent")


QUERIES["a33_ahp_weights"] = _priorities
ORACLES["a33_ahp_weights"] = """WITH r AS (SELECT p_partkey // 3 AS matrix, CASE p_partkey % 3 WHEN 2 THEN 1 ELSE 0 END AS i, CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 2 END AS j, greatest(1 / 9e0, least(9e0, p_size / 4e0)) AS v FROM part),
m AS (SELECT matrix, i, j, v FROM r UNION ALL SELECT matrix, j, i, 1 / v FROM r UNION ALL SELECT matrix, x, x, 1e0 FROM (SELECT DISTINCT matrix, unnest([i, j]) AS x FROM r)),
w AS (SELECT matrix, i, avg(v / s) AS w FROM m JOIN (SELECT matrix, j, sum(v) AS s FROM m GROUP BY 1, 2) USING (matrix, j) GROUP BY 1, 2),
p AS (SELECT m.matrix, m.i, sum(v * w.w) AS p FROM m JOIN w ON w.matrix = m.matrix AND w.i = m.j GROUP BY 1, 2),
l AS (SELECT matrix, avg(p / w) AS l, count(*) AS n FROM p JOIN w USING (matrix, i) GROUP BY 1), c AS (SELECT matrix, l, n, CASE WHEN n > 1 THEN (l - n) / (n - 1) ELSE 0 END AS ci FROM l)
SELECT matrix, i, round(w, 6) AS weight, round(l, 6) AS lambda_max, round(ci, 6) AS ci, round(CASE WHEN n > 2 THEN ci / 0.58e0 ELSE 0 END, 5) AS cr, n <= 2 OR ci / 0.58e0 <= 0.1e0 AS consistent FROM w JOIN c USING (matrix)"""
