"""Queries of the network and search operators over the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.impedance import edge_cost, travel_seconds
from ..functions import access
from ..functions.profiles import profiles, turn_models
from ..operators import corridor, network, polyline, running, search, spatial
from ..sources.fixtures import view, with_views
from .scalar import sql_haversine

QUERIES, ORACLES = {}, {}
#: Nodes that searches start from, and minutes of isochrones.
ORIGINS, BANDS = (0, 1, 2, 3), (5, 10, 15)


def _segments(spark, sf_dir):
    return view(spark, sf_dir, "grid_segments").withColumns({"oneway": F.col("code").isin(3, 11), "steps": F.col("code") == 7, "rank": F.when(F.col("code") % 10 == 0, 2).otherwise(4), "quality": F.when(F.col("code") == 5, 0.42).otherwise(1.0)})


def _edges(spark, sf_dir):
    return network.directed_edges(_segments(spark, sf_dir), attributes=("code", "steps", "rank", "quality"))


def _costed(spark, sf_dir, profile: str, seconds: bool):
    one = F.broadcast(profiles(spark).where(F.col("profile") == profile))
    rows = _edges(spark, sf_dir).crossJoin(one)
    cost = edge_cost("length_m", "slope_pct", "steps", "quality", "rank")
    if seconds:
        cost = F.when(cost.isNotNull(), travel_seconds("length_m", "slope_pct", "rank"))
    blocked = (F.col("category") == "vehicle") & F.col("against_oneway")
    return rows.select("u", "v", F.when(~blocked, cost).alias("cost"))


_EDGES = f"""{with_views('grid_segments')},
seg AS (SELECT *, code IN (3, 11) AS oneway, code = 7 AS steps, CASE WHEN code % 10 = 0 THEN 2 ELSE 4 END AS rank, CASE WHEN code = 5 THEN 0.42e0 ELSE 1e0 END AS quality, greatest(0.1e0, {sql_haversine('lon1', 'lat1', 'lon2', 'lat2')}) AS length_m FROM grid_segments),
edges AS (SELECT u, v, length_m, 100 * (z2 - z1) / greatest(1e0, length_m) AS slope, FALSE AS against, oneway, steps, rank, quality FROM seg
 UNION ALL SELECT v, u, length_m, 100 * (z1 - z2) / greatest(1e0, length_m), oneway, oneway, steps, rank, quality FROM seg)"""
_ADULT = "length_m * CASE WHEN abs(slope) > 25 THEN 1 + 20 * pow(abs(slope) / 25e0, 3) ELSE 1 + 1.5e0 * abs(slope) / 10 END * CASE WHEN steps THEN 1.2e0 ELSE 1 END * CASE rank WHEN 2 THEN 1.8e0 ELSE 1e0 END"
_WALK = "length_m / (greatest(0.5e0, least(8e0, 6e0 * exp(-3.5e0 * abs(greatest(-0.6e0, least(0.6e0, slope / 100)) + 0.05e0)))) / 3.6e0)"
_PATHS = """{edges}, w AS (SELECT u, v, min({cost}) AS c FROM edges GROUP BY 1, 2), starts AS ({starts}),
paths(o, node, c) USING KEY (o, node) AS (SELECT o, o AS node, 0e0 AS c FROM starts UNION
 SELECT p.o, w.v, min(p.c + w.c) FROM paths p JOIN w ON w.u = p.node LEFT JOIN recurring.paths r ON r.o = p.o AND r.node = w.v WHERE p.c + w.c <= {limit} AND (r.c IS NULL OR p.c + w.c < r.c) GROUP BY 1, 2)
"""


_STARTS = f"SELECT unnest([{', '.join(map(str, ORIGINS))}])::BIGINT AS o"


def _origins(spark, sf_dir):
    return spark.createDataFrame([(o,) for o in ORIGINS], "origin long")


QUERIES["g01_directed_edges"] = lambda spark, sf_dir: _edges(spark, sf_dir).select("u", "v", F.round("length_m", 4).alias("length_m"), F.round("slope_pct", 4).alias("slope"), "against_oneway")
ORACLES["g01_directed_edges"] = _EDGES + " SELECT u, v, round(length_m, 4) AS length_m, round(slope, 4) AS slope, against AS against_oneway FROM edges"
QUERIES["a06_node_degree"] = lambda spark, sf_dir: network.degrees(_edges(spark, sf_dir)).select(F.col("u").alias("node"), "degree")
ORACLES["a06_node_degree"] = _EDGES + " SELECT u AS node, count(DISTINCT v) AS degree FROM edges GROUP BY 1"


def _components(spark, sf_dir):
    kept = _costed(spark, sf_dir, "wheelchair", False).where("cost is not null")
    return network.components(kept).groupBy("component").agg(F.count("*").alias("nodes"), F.sum("node").alias("node_sum"))


QUERIES["a07_components"] = _components
ORACLES["a07_components"] = _EDGES + """, k AS (SELECT u AS a, v AS b FROM edges WHERE NOT steps AND abs(slope) <= 8.33e0),
reach(node, c) USING KEY (node) AS (SELECT DISTINCT a AS node, a AS c FROM k UNION SELECT k.b, min(r.c) FROM reach r JOIN k ON k.a = r.node JOIN recurring.reach t ON t.node = k.b WHERE r.c < t.c GROUP BY 1)
SELECT c AS component, count(*) AS nodes, sum(node)::BIGINT AS node_sum FROM reach GROUP BY 1"""
QUERIES["a05_graph_counts"] = lambda spark, sf_dir: _edges(spark, sf_dir).agg(F.countDistinct("u").alias("nodes"), F.count("*").alias("edges"), F.count_if("against_oneway").alias("one_way"))
ORACLES["a05_graph_counts"] = _EDGES + " SELECT count(DISTINCT u) AS nodes, count(*) AS edges, count_if(against)::BIGINT AS one_way FROM edges"


def _fill(spark, sf_dir):
    nodes = view(spark, sf_dir, "grid_nodes").select(F.col("node_id").alias("node"), F.when(F.col("node_id") % 5 == 0, F.col("z")).alias("z"))
    return network.fill_heights(nodes, _segments(spark, sf_dir)).select("node", F.round("z", 5).alias("z"))


QUERIES["a08_fill_heights"] = _fill
#: Rings, unrolled; more than the grid has.
ORACLES["a08_fill_heights"] = (
    with_views("grid_segments")
    + ", links AS (SELECT u, v FROM grid_segments UNION ALL SELECT v, u FROM grid_segments), r0 AS (SELECT node_id AS node, CASE WHEN node_id % 5 = 0 THEN z END AS z FROM grid_nodes)"
    + "".join(f", r{k + 1} AS (SELECT a.node, coalesce(any_value(a.z), avg(b.z)) AS z FROM r{k} a LEFT JOIN links l ON l.u = a.node AND a.z IS NULL LEFT JOIN r{k} b ON b.node = l.v GROUP BY 1)" for k in range(6))
    + " SELECT node, round(coalesce(z, 0), 5) AS z FROM r6"
)


def _one_to_many(spark, sf_dir):
    return search.shortest_paths(_costed(spark, sf_dir, "adult", False), _origins(spark, sf_dir)).select("origin", "node", F.round("cost", 4).alias("cost"))


QUERIES["g06_one_to_many"] = _one_to_many
ORACLES["g06_one_to_many"] = _PATHS.format(edges=_EDGES, cost=_ADULT, starts=_STARTS, limit="1e18") + "SELECT o AS origin, node, round(c, 4) AS cost FROM paths"


def _isochrone(spark, sf_dir):
    seconds = search.shortest_paths(_costed(spark, sf_dir, "adult", True), _origins(spark, sf_dir), BANDS[-1] * 60.0)
    bands = spark.createDataFrame([(b,) for b in BANDS], "minutes int")
    return seconds.join(F.broadcast(bands), F.col("cost") <= F.col("minutes") * 60).groupBy("origin", "minutes").agg(F.count("*").alias("nodes"), F.round(F.sum("cost"), 3).alias("seconds"))


QUERIES["g13_isochrone_bands"] = _isochrone
ORACLES["g13_isochrone_bands"] = _PATHS.format(edges=_EDGES, cost=_WALK, starts=_STARTS, limit=f"{BANDS[-1] * 60}e0") + f"SELECT o AS origin, minutes, count(*) AS nodes, round(sum(c), 3) AS seconds FROM paths, (SELECT unnest([{', '.join(map(str, BANDS))}])::INT AS minutes) b WHERE c <= minutes * 60 GROUP BY 1, 2"


def _od(spark, sf_dir):
    """Seconds by car from every facility to every zone, over their nearest nodes."""
    nodes = view(spark, sf_dir, "grid_nodes").select("node_id", "lon", "lat")
    snap = lambda name, key: spatial.nearest(view(spark, sf_dir, name).select(key, "lon", "lat"), nodes, key, "node_id", 1000.0).select(key, "node_id")
    origins, goals = snap("facilities", "facility_id"), snap("zones", "zone_id")
    paths = search.shortest_paths(_costed(spark, sf_dir, "car", True), origins.select(F.col("node_id").alias("origin")), goals=goals.select(F.col("node_id").alias("node")))
    pairs = paths.join(origins, paths["origin"] == origins["node_id"]).drop("node_id").join(goals, paths["node"] == goals["node_id"])
    return pairs.select("facility_id", "zone_id", F.round("cost", 3).alias("seconds"))


QUERIES["g11_od_matrix"] = _od
_CAR = "length_m / (greatest(10e0, CASE rank WHEN 2 THEN 60e0 ELSE 30e0 END * greatest(0.5e0, 1 - least(35e0, abs(slope)) / 100 * 0.85e0)) / 3.6e0)"
_SNAP = "{t} AS (SELECT {k}, arg_min(node_id, struct_pack(d := d, n := node_id)) AS node FROM (SELECT a.{k}, b.node_id, {d} AS d FROM {v} a, grid_nodes b) WHERE d <= 1000 GROUP BY 1)"
_AB = sql_haversine("a.lon", "a.lat", "b.lon", "b.lat")
ORACLES["g11_od_matrix"] = (
    _PATHS.format(
        edges=_EDGES.replace("WITH RECURSIVE", with_views("zones", "facilities") + ",", 1).replace("FROM seg\n UNION", "FROM seg WHERE NOT steps AND abs(z2 - z1) * 100 <= 25 * length_m\n UNION").replace("quality FROM seg)", "quality FROM seg WHERE NOT oneway AND NOT steps AND abs(z2 - z1) * 100 <= 25 * length_m)")
        + f", {_SNAP.format(t='so', k='facility_id', v='facilities', d=_AB)}, {_SNAP.format(t='sz', k='zone_id', v='zones', d=_AB)}",
        cost=_CAR, starts="SELECT DISTINCT node AS o FROM so", limit="1e18",
    )
    + "SELECT facility_id, zone_id, round(c, 3) AS seconds FROM paths JOIN so ON so.node = paths.o JOIN sz ON sz.node = paths.node"
)


def _turns(spark, sf_dir):
    """Least costs by car with turns: left turns and U-turns cost time."""
    edges = _costed(spark, sf_dir, "car", False).where("cost is not null").groupBy("u", "v").agg(F.min("cost").alias("cost"))
    places = view(spark, sf_dir, "grid_nodes").select(F.col("node_id").alias("node"), "lon", "lat")
    steps = search.turn_graph(edges, places, network.degrees(_edges(spark, sf_dir)), turn_models(spark).where("profile = 'car'"), 50.0 / 3.6)
    return search.turn_paths(steps, _origins(spark, sf_dir)).select("origin", "node", F.round("cost", 3).alias("cost"))


QUERIES["g05_turn_search"] = _turns
_CAR_COST = "length_m * (1 + 1.5e0 * abs(slope) / 10 * 0.5e0) * CASE WHEN quality < 0.5e0 THEN 1 + 4 * (0.5e0 - quality) ELSE 1 END * CASE rank WHEN 2 THEN 0.8e0 ELSE 1.5e0 END"
ORACLES["g05_turn_search"] = _EDGES + f""", deg AS (SELECT u AS b, count(DISTINCT v) AS g FROM edges GROUP BY 1),
w AS (SELECT u, v, min({_CAR_COST}) AS c FROM edges WHERE NOT against AND NOT steps AND abs(slope) <= 25 GROUP BY 1, 2),
t AS (SELECT a.u AS a, a.v AS b, c.v AS c, c.c AS cost, g, degrees(atan2((nc.lon - nb.lon) * cos(radians(nb.lat)), nc.lat - nb.lat) - atan2((nb.lon - na.lon) * cos(radians(nb.lat)), nb.lat - na.lat)) AS r
 FROM w a JOIN w c ON c.u = a.v JOIN deg ON deg.b = a.v JOIN grid_nodes na ON na.node_id = a.u JOIN grid_nodes nb ON nb.node_id = a.v JOIN grid_nodes nc ON nc.node_id = c.v),
f AS (SELECT *, CASE WHEN r > 180 THEN r - 360 WHEN r < -180 THEN r + 360 ELSE r END AS x FROM t),
k AS (SELECT a * 100000 + b AS u, b * 100000 + c AS v, cost + 50e0 / 3.6e0 * CASE WHEN abs(x) >= 165 THEN CASE WHEN g = 1 THEN 30e0 END WHEN g < 3 OR abs(x) < 30 THEN 0e0 ELSE CASE WHEN x < 0 THEN 6e0 ELSE 2e0 END + CASE WHEN abs(x) >= 120 THEN 4e0 ELSE 0e0 END END AS c FROM f),
steps AS (SELECT u, v, c FROM k WHERE c IS NOT NULL UNION ALL SELECT -1 - u, u * 100000 + v, c FROM w), starts AS ({_STARTS}),
paths(o, e, c) USING KEY (o, e) AS (SELECT o, -1 - o AS e, 0e0 AS c FROM starts UNION
 SELECT p.o, s.v, min(p.c + s.c) FROM paths p JOIN steps s ON s.u = p.e LEFT JOIN recurring.paths r ON r.o = p.o AND r.e = s.v WHERE r.c IS NULL OR p.c + s.c < r.c GROUP BY 1, 2)
SELECT o AS origin, CASE WHEN e < 0 THEN -1 - e ELSE e % 100000 END AS node, round(min(c), 3) AS cost FROM paths GROUP BY 1, 2"""

_AUDIT = {"highway": "CASE code % 6 WHEN 0 THEN 'residential' WHEN 1 THEN 'footway' WHEN 2 THEN 'motorway' WHEN 3 THEN 'steps' WHEN 4 THEN 'primary' ELSE 'cycleway' END", "access": "CASE WHEN code = 12 THEN 'private' ELSE '' END", "bicycle": "CASE WHEN code = 9 THEN 'yes' WHEN code = 16 THEN 'no' ELSE '' END"}


def _audit(spark, sf_dir):
    """Whether a network serves cyclists: allowed segments, and the largest connected part of them against all nodes."""
    tagged = _segments(spark, sf_dir).select("u", "v", *(F.expr(x).alias(a) for a, x in _AUDIT.items()))
    none = {a: F.lit("") for a in ("foot", "motor_vehicle", "lit", "oneway_bicycle", "oneway_foot")} | {a: F.lit(False) for a in ("oneway", "against_oneway", "reverse_of_two_way")}
    judged = tagged.crossJoin(F.broadcast(profiles(spark).where("profile = 'bicycle'").select("profile", "category"))).withColumn("ok", access.edge_access("profile", "category", none | {a: F.col(a) for a in _AUDIT})["allowed"])
    counts = judged.agg(F.count("*").alias("segments"), F.count_if("ok").alias("allowed"))
    nodes = judged.select("u").union(judged.select("v")).distinct().agg(F.count("*").alias("nodes"))
    parts = network.components(judged.where("ok")).groupBy("component").count().agg(F.count("*").alias("components"), F.max("count").alias("largest"))
    share = 100.0 * F.col("largest") / F.col("nodes")
    row = counts.crossJoin(nodes).crossJoin(parts)  # one row each
    return row.select("segments", "allowed", "nodes", "components", F.round(share, 4).alias("largest_pct"), ((F.col("allowed") > 0) & (F.col("nodes") >= 2) & (share >= 80)).alias("ready"))


QUERIES["a10_network_audit"] = _audit
ORACLES["a10_network_audit"] = _EDGES + f""", j AS (SELECT u, v, CASE WHEN b = 'no' THEN FALSE WHEN b = '' AND a = 'private' THEN FALSE WHEN b = 'yes' THEN TRUE ELSE h NOT IN ('motorway', 'steps') END AS ok FROM (SELECT u, v, {_AUDIT['highway']} AS h, {_AUDIT['access']} AS a, {_AUDIT['bicycle']} AS b FROM seg)),
k AS (SELECT u AS a, v AS b FROM j WHERE ok UNION SELECT v, u FROM j WHERE ok),
reach(node, c) USING KEY (node) AS (SELECT DISTINCT a AS node, a AS c FROM k UNION SELECT k.b, min(r.c) FROM reach r JOIN k ON k.a = r.node JOIN recurring.reach t ON t.node = k.b WHERE r.c < t.c GROUP BY 1),
p AS (SELECT count(*) AS components, max(n) AS largest FROM (SELECT count(*) AS n FROM reach GROUP BY c)), n AS (SELECT count(DISTINCT x) AS nodes FROM (SELECT u AS x FROM j UNION ALL SELECT v FROM j)), c AS (SELECT count(*) AS segments, count_if(ok)::BIGINT AS allowed FROM j)
SELECT segments, allowed, nodes, components, round(100e0 * largest / nodes, 4) AS largest_pct, 100e0 * largest / nodes >= 80 AS ready FROM c, n, p"""


def _snapped(spark, sf_dir, name: str, key: str):
    nodes = view(spark, sf_dir, "grid_nodes").select("node_id", "lon", "lat")
    return spatial.nearest(view(spark, sf_dir, name).select(key, "lon", "lat"), nodes, key, "node_id", 1000.0).select(key, "node_id")


def _places(spark, sf_dir):
    return view(spark, sf_dir, "grid_nodes").select(F.col("node_id").alias("node"), "lon", "lat", "z")


def _batch(spark, sf_dir):
    """The n-th zone to the n-th facility, on foot, with the totals of each route."""
    a, b = _snapped(spark, sf_dir, "zones", "zone_id").withColumnRenamed("node_id", "origin"), _snapped(spark, sf_dir, "facilities", "facility_id").withColumnRenamed("node_id", "node")
    asked = running.zipped(view(spark, sf_dir, "zones").select("zone_id"), "zone_id", view(spark, sf_dir, "facilities").select("facility_id"), "facility_id")
    pairs = asked.join(a, "zone_id").join(b, "facility_id").select("pair_id", "origin", "node")  # those that reach the network
    found = search.routes(_costed(spark, sf_dir, "adult", False), pairs)
    totals = polyline.route_totals(polyline.steps(search.path_points(found, _places(spark, sf_dir))))
    return found.join(totals, found["pair_id"] == totals["route_id"], "left").select("pair_id", F.round("cost", 4).alias("cost"), F.size("path").alias("nodes"), F.round("distance_m", 2).alias("distance_m"), F.round("gain_m", 2).alias("gain_m"))


QUERIES["g12_batch_routes"] = _batch
#: Ways back from each asked pair's goal, a row for every node of them; d and g: distance and climb from there to the goal.
_WALKS = """, pre AS (SELECT p.o, w.v AS node, arg_min(w.u, struct_pack(c := p.c + w.c, u := w.u)) AS u FROM paths p JOIN w ON w.u = p.node GROUP BY 1, 2),
walk(pair, o, node, d, g, n) AS (SELECT pair, o, node, 0e0 AS d, 0e0 AS g, 1 AS n FROM asked JOIN paths USING (o, node) UNION ALL
 SELECT k.pair, k.o, pre.u, k.d + sqrt(pow({ab}, 2) + pow(b.z - a.z, 2)), k.g + greatest(0e0, b.z - a.z), k.n + 1 FROM walk k JOIN pre ON pre.o = k.o AND pre.node = k.node JOIN grid_nodes a ON a.node_id = pre.u JOIN grid_nodes b ON b.node_id = k.node WHERE k.node <> k.o)"""
_ENDS = f"""{_EDGES.replace('WITH RECURSIVE', with_views('zones', 'facilities') + ',', 1)}, {_SNAP.format(t='so', k='facility_id', v='facilities', d=_AB)}, {_SNAP.format(t='sz', k='zone_id', v='zones', d=_AB)}"""
_ASKED = """, asked AS (SELECT pair, sz.node AS o, so.node AS node FROM (SELECT zone_id, row_number() OVER (ORDER BY zone_id) AS pair FROM zones) JOIN (SELECT facility_id, row_number() OVER (ORDER BY facility_id) AS pair FROM facilities) USING (pair) JOIN sz USING (zone_id) JOIN so USING (facility_id))"""
ORACLES["g12_batch_routes"] = (
    _PATHS.format(edges=_ENDS + _ASKED, cost=_ADULT, starts="SELECT DISTINCT o FROM asked", limit="1e18")
    + _WALKS.format(ab=_AB)
    + " SELECT pair AS pair_id, round(c, 4) AS cost, n AS nodes, CASE WHEN n > 1 THEN round(d, 2) END AS distance_m, CASE WHEN n > 1 THEN round(g, 2) END AS gain_m FROM walk k JOIN asked USING (pair) JOIN paths ON paths.o = asked.o AND paths.node = asked.node WHERE k.node = k.o"
)
#: Metres in a straight line to the musters that are tried.
MUSTER_M = 800.0
HAZARDS = ((1, 27.105, 38.405, 200.0, 100.0), (2, 27.115, 38.415, 220.0, 100.0))


def _evacuation(spark, sf_dir):
    """From the node of every zone to the best of the facilities within MUSTER_M, on foot."""
    nodes = _places(spark, sf_dir).select("node", "lon", "lat")
    musters = _snapped(spark, sf_dir, "facilities", "facility_id").join(nodes.withColumnRenamed("node", "node_id"), "node_id").select(F.col("facility_id").alias("muster"), "node_id", "lon", "lat")
    origins = _snapped(spark, sf_dir, "zones", "zone_id").select(F.col("node_id").alias("origin")).distinct().join(nodes.withColumnRenamed("node", "origin"), "origin")
    musters = musters.groupBy("node_id", "lon", "lat").agg(F.min("muster").alias("muster"))  # those of one node tie, and the smallest wins
    near = spatial.within(origins, musters, MUSTER_M)
    pairs = network.stored(near.select((F.col("origin") * (1 << 31) + F.col("muster")).alias("pair_id"), "origin", F.col("node_id").alias("node"), "muster"), "pairs")
    found = network.stored(search.routes(_costed(spark, sf_dir, "adult", True), pairs), "found")
    hazards = spark.createDataFrame(list(HAZARDS), "hazard_id int, lon double, lat double, radius_m double, severity double")
    best = corridor.evacuation(found, search.path_points(found, _places(spark, sf_dir)), pairs.select("pair_id", "origin", "muster"), hazards)
    return best.select("origin", "muster", *(F.round(c, 3).alias(c) for c in ("minutes", "risk", "clearance_m")))


QUERIES["a31_evacuation"] = _evacuation
_HAZARDS = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE, {r}::DOUBLE, {s}::DOUBLE)" for i, x, y, r, s in HAZARDS)
ORACLES["a31_evacuation"] = (
    _PATHS.format(
        edges=_ENDS + f", asked AS (SELECT a.node_id * 2147483648 + so.facility_id AS pair, a.node_id AS o, so.node, so.facility_id AS muster FROM (SELECT DISTINCT node AS node_id FROM sz) z JOIN grid_nodes a USING (node_id), so JOIN grid_nodes b ON b.node_id = so.node WHERE {_AB} <= {MUSTER_M})",
        cost=_WALK, starts="SELECT DISTINCT o FROM asked", limit="1e18",
    )
    + _WALKS.format(ab=_AB)
    + f""", h(h, lon, lat, r, s) AS (VALUES {_HAZARDS}),
near AS (SELECT pair, h, any_value(r) AS r, any_value(s) AS s, min({sql_haversine('a.lon', 'a.lat', 'h.lon', 'h.lat')}) AS d FROM walk k JOIN grid_nodes a ON a.node_id = k.node, h GROUP BY 1, 2),
risk AS (SELECT pair, sum(greatest(0e0, r - d) * s) AS risk, min(d) AS d FROM near GROUP BY 1),
best AS (SELECT asked.o AS origin, min(struct_pack(total := c / 60 + risk / 60, muster := muster, minutes := c / 60, risk := risk, d := d)) AS b FROM asked JOIN paths ON paths.o = asked.o AND paths.node = asked.node JOIN risk USING (pair) GROUP BY 1)
SELECT origin, b.muster AS muster, round(b.minutes, 3) AS minutes, round(b.risk, 3) AS risk, round(b.d, 3) AS clearance_m FROM best"""
)
