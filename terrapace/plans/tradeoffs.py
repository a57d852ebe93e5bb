"""Queries of the Pareto search and its lower bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bounds, context
from ..functions.impedance import travel_seconds
from ..functions.profiles import with_profile
from ..operators import network, pareto, spatial
from ..sources.fixtures import view, with_views
from .network import _AB, _EDGES, _SNAP, _WALK, _edges, _snapped
from .scalar import _P, sql_haversine

QUERIES, ORACLES = {}, {}
#: Facilities this near to another one ask for the ways to the nearest.
NEAR_M = 600.0


def _vectors(spark, sf_dir):
    """Edges with a walker's objectives, as whole thousandths."""
    nodes = view(spark, sf_dir, "grid_nodes")
    ends = nodes.select(F.col("node_id").alias("u"), F.col("z").alias("z1")), nodes.select(F.col("node_id").alias("v"), F.col("z").alias("z2"), "lst")
    rows = network.stored(_edges(spark, sf_dir).select("u", "v", "length_m", "slope_pct", "rank").join(ends[0], "u").join(ends[1], "v"), "edges")
    rows = with_profile(rows, "adult")
    seconds = travel_seconds("length_m", "slope_pct", "rank")
    vector = context.edge_vector("profile", "category", "length_m", "slope_pct", "z1", "z2", seconds, "lst")
    return rows.withColumn("x", vector).select("u", "v", "x.*").select("u", "v", *pareto.whole())


def _pairs(spark, sf_dir):
    """Each facility and the nearest other one that stands at another node, by their nodes."""
    nodes = view(spark, sf_dir, "grid_nodes").select("node_id", "lon", "lat")
    placed = network.stored(_snapped(spark, sf_dir, "facilities", "facility_id"), "placed")
    firsts = placed.groupBy("node_id").agg(F.min("facility_id").alias("facility_id")).join(nodes, "node_id")  # of one node's facilities the first is taken
    near = spatial.within(firsts.select(F.col("node_id").alias("origin"), "lon", "lat"), firsts.withColumnRenamed("node_id", "node"), NEAR_M, distance="d").where("origin <> node")
    near = near.groupBy("origin").agg(F.min_by("node", F.struct(F.round("d", 3), "facility_id")).alias("node"))
    return placed.select(F.col("facility_id").alias("query"), F.col("node_id").alias("origin")).join(near, "origin")


def _frontier(spark, sf_dir):
    asked = network.stored(_pairs(spark, sf_dir), "asked")
    pairs = asked.groupBy("origin", "node").agg(F.min("query").alias("pair"))  # facilities of one node share a search
    solutions, _ = pareto.frontier(_vectors(spark, sf_dir), pairs.withColumnRenamed("pair", "query"))
    solutions = network.stored(solutions.withColumnRenamed("query", "pair"), "solutions")
    kept = pareto.thinned(solutions.withColumnRenamed("pair", "query")).select(F.col("query").alias("q"), F.col("label").alias("l"))
    rows = solutions.join(kept, (F.col("pair") == F.col("q")) & (F.col("label") == F.col("l")), "left").select("pair", *pareto.OBJECTIVES, F.col("l").isNotNull().alias("kept"))
    return asked.join(pairs, ["origin", "node"]).select("query", "pair").join(rows, "pair").select("query", *pareto.OBJECTIVES, "kept")


QUERIES["g14_pareto_frontier"] = _frontier
_KCAL = "greatest(0.6e0, 280.5e0 * pow(x, 5) - 58.7e0 * pow(x, 4) - 76.8e0 * pow(x, 3) + 51.9e0 * x * x + 19.6e0 * x + 2.5e0) * 70 * length_m / 4184e0"
_LOW = "low_{c}(goal, n, c) USING KEY (goal, n) AS (SELECT DISTINCT goal, goal AS n, 0::BIGINT AS c FROM pairs UNION SELECT p.goal, e.u, min(p.c + e.{c}) FROM low_{c} p JOIN vec e ON e.v = p.n LEFT JOIN recurring.low_{c} r ON r.goal = p.goal AND r.n = e.u WHERE r.c IS NULL OR p.c + e.{c} < r.c GROUP BY 1, 2)"
_LE = "{a}.t <= {b}.t AND {a}.a <= {b}.a AND {a}.h <= {b}.h AND {a}.k <= {b}.k"
ORACLES["g14_pareto_frontier"] = f"""{_EDGES.replace('WITH RECURSIVE', with_views('facilities') + ',', 1)}, {_SNAP.format(t='so', k='facility_id', v='facilities', d=_AB)},
vec AS (SELECT u, v, round({_WALK} * 1000)::BIGINT AS t, round(greatest(0e0, zv - zu) * 1000)::BIGINT AS a, round(lst * length_m / 100 * 1000)::BIGINT AS h, round({_KCAL} * 1000)::BIGINT AS k
 FROM (SELECT e.*, a.z AS zu, b.z AS zv, b.lst, greatest(-0.5e0, least(0.5e0, slope / 100)) AS x FROM edges e JOIN grid_nodes a ON a.node_id = u JOIN grid_nodes b ON b.node_id = v)),
pl AS (SELECT facility_id, node, lon, lat FROM so JOIN grid_nodes ON node_id = node),
pairs AS (SELECT a.facility_id AS q, a.node AS origin, arg_min(b.node, struct_pack(d := round({_AB}, 3), f := b.facility_id)) AS goal FROM pl a JOIN pl b ON a.node <> b.node WHERE {_AB} <= {NEAR_M} GROUP BY 1, 2),
{', '.join(_LOW.format(c=c) for c in 'tahk')},
low AS (SELECT goal, n, low_t.c AS t, low_a.c AS a, low_h.c AS h, low_k.c AS k FROM low_t JOIN low_a USING (goal, n) JOIN low_h USING (goal, n) JOIN low_k USING (goal, n)),
labels(q, goal, n, t, a, h, k) USING KEY (q, n, t, a, h, k) AS (SELECT q, goal, origin AS n, 0::BIGINT AS t, 0::BIGINT AS a, 0::BIGINT AS h, 0::BIGINT AS k FROM pairs
 UNION (WITH c AS MATERIALIZED (SELECT DISTINCT l.q, l.goal, e.v AS n, l.t + e.t AS t, l.a + e.a AS a, l.h + e.h AS h, l.k + e.k AS k FROM labels l JOIN vec e ON e.u = l.n),
  d AS MATERIALIZED (SELECT c.* FROM c LEFT JOIN recurring.labels r ON r.q = c.q AND r.n = c.n AND {_LE.format(a='r', b='c')} WHERE r.q IS NULL),
  f AS MATERIALIZED (SELECT d.* FROM d JOIN low ON low.goal = d.goal AND low.n = d.n LEFT JOIN recurring.labels s ON s.q = d.q AND s.n = d.goal AND s.t <= d.t + low.t AND s.a <= d.a + low.a AND s.h <= d.h + low.h AND s.k <= d.k + low.k WHERE s.q IS NULL)
  SELECT f.* FROM f LEFT JOIN f g ON g.q = f.q AND g.n = f.n AND {_LE.format(a='g', b='f')} AND NOT ({_LE.format(a='f', b='g')}) WHERE g.q IS NULL)),
best AS (SELECT x.* FROM labels x LEFT JOIN labels y ON y.q = x.q AND y.n = x.n AND {_LE.format(a='y', b='x')} AND NOT ({_LE.format(a='x', b='y')}) WHERE x.n = x.goal AND y.q IS NULL),
thin AS (SELECT q, list_reduce(list_prepend([NULL], list_transform(list({{t: t, a: a, h: h, k: k}} ORDER BY t, a, h, k), lambda x: [x])),
 lambda kept, x: CASE WHEN len(list_filter(kept, lambda s: s IS NOT NULL AND s.t <= x[1].t * 1.03e0 AND s.a <= x[1].a * 1.03e0 AND s.h <= x[1].h * 1.03e0 AND s.k <= x[1].k * 1.03e0)) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept FROM best GROUP BY q)
SELECT best.q AS query, t AS time_s, a AS ascent_m, h AS heat, k AS kcal, list_contains(kept, {{t: t, a: a, h: h, k: k}}) AS kept FROM best JOIN thin USING (q)"""


def _bounds(spark, sf_dir):
    """What the way from each zone to its nearest facility costs at least, whatever the streets, for every profile."""
    near = spatial.nearest_place(view(spark, sf_dir, "zones").select("zone_id", "lon", "lat"), view(spark, sf_dir, "facilities"), "facility_id", 3000.0, 187.5).withColumnRenamed("distance_m", "d")
    metres = bounds.planar_metres("lon", "lat", "lon_r", "lat_r", F.greatest(F.abs("lat"), F.abs("lat_r")))
    rows = near.withColumn("metres", metres).crossJoin(F.broadcast(bounds.profile_bounds(spark)))
    return rows.select("zone_id", "profile", (F.col("metres") <= F.col("d")).alias("admissible"), F.round("metres", 3).alias("metres"), F.round(F.col("metres") * F.col("seconds"), 3).alias("seconds"), F.round(F.col("metres") * F.col("kcal"), 4).alias("kcal"), F.round(F.col("metres") * F.col("cost"), 3).alias("cost"))


QUERIES["g17_lower_bounds"] = _bounds
_RIDE = "CASE WHEN y < -0.02e0 THEN least(45e0, {base} * (1 + abs(y) * 2.2e0)) ELSE greatest(3.5e0, least({base} * 1.5e0, 160e0 / greatest(1e0, 85e0 * 9.80665e0 * sin(atan(y)) + 0.004e0 * 85e0 * 9.80665e0 * cos(atan(abs(y)))) * 3.6e0)) END"
_KMH = f"""CASE WHEN category = 'pedestrian' THEN greatest(0.5e0, least(8e0, 6 * exp(-3.5e0 * abs(s + 0.05e0)) * greatest(0.2e0, base_kmh / 5))) WHEN profile IN ('bicycle', 'mtb') THEN {_RIDE.format(base='base_kmh')}
 WHEN profile = 'scooter' THEN CASE WHEN s > 0.12e0 THEN 4e0 WHEN s > 0 THEN greatest(4e0, base_kmh * greatest(0.25e0, 1 - pow(greatest(s, 0) / 0.14e0, 1.5e0))) ELSE least(25e0, base_kmh * (1 + abs(greatest(-0.2e0, s)) * 0.5e0)) END
 ELSE greatest(10e0, ((CASE r WHEN 1 THEN 80e0 WHEN 2 THEN 60e0 WHEN 3 THEN 45e0 WHEN 4 THEN 30e0 ELSE 20e0 END) * base_kmh / 50 + 10) * greatest(0.5e0, 1 - least(35e0, abs(s * 100)) / 100 * 0.85e0)) END"""
_CYCLE = "greatest(0e0, 85e0 * 9.80665e0 * sin(atan(x)) + 0.004e0 * 85e0 * 9.80665e0 * cos(atan(abs(x))) + 0.5e0 * 1.225e0 * 0.88e0 * 0.55e0 * pow(ride / 3.6e0, 3) / greatest(0.1e0, ride / 3.6e0)) / 0.24e0 / 4184e0"
ORACLES["g17_lower_bounds"] = f"""{with_views('zones', 'facilities')}, {_P}, sp AS (SELECT profile, 0.95e0 * min(1 / greatest(0.2e0, {_KMH} / 3.6e0)) AS sec FROM (SELECT p.*, s, r, greatest(-0.25e0, least(0.25e0, s)) AS y FROM p, (SELECT unnest(range(-20, 21)) * 0.02e0 AS s) g, (SELECT unnest(range(1, 6)) AS r) h) GROUP BY 1),
en AS (SELECT profile, greatest(0e0, min(CASE WHEN category = 'pedestrian' THEN greatest(0.6e0, 280.5e0 * pow(x5, 5) - 58.7e0 * pow(x5, 4) - 76.8e0 * pow(x5, 3) + 51.9e0 * x5 * x5 + 19.6e0 * x5 + 2.5e0) * 70 / 4184e0 WHEN profile IN ('bicycle', 'mtb') THEN {_CYCLE} ELSE 0e0 END)) AS kcal
 FROM (SELECT *, {_RIDE.format(base='18e0')} AS ride FROM (SELECT p.*, greatest(-0.5e0, least(0.5e0, s)) AS x5, greatest(-0.3e0, least(0.3e0, s)) AS x, greatest(-0.25e0, least(0.25e0, s)) AS y FROM p, (SELECT unnest(range(-100, 101)) / 100e0 AS s) g)) GROUP BY 1),
f AS (SELECT a.zone_id, a.lon, a.lat, arg_min(struct_pack(lon := b.lon, lat := b.lat), struct_pack(d := {_AB}, f := b.facility_id)) AS g, min({_AB}) AS d FROM zones a, facilities b WHERE {_AB} <= 3000 GROUP BY 1, 2, 3),
m AS (SELECT zone_id, d, sqrt(pow((lon - g.lon) * 111195.0802335329e0 * 0.999e0 * cos(radians(greatest(abs(lat), abs(g.lat)))), 2) + pow((lat - g.lat) * 111195.0802335329e0 * 0.999e0, 2)) AS metres FROM f)
SELECT zone_id, profile, metres <= d AS admissible, round(metres, 3) AS metres, round(metres * sec, 3) AS seconds, round(metres * kcal, 4) AS kcal, round(metres * greatest(1e-6, 0.6e0 * least(1e0, h1, h2, h3, h4, h5)), 3) AS cost FROM m, p JOIN sp USING (profile) JOIN en USING (profile)"""
