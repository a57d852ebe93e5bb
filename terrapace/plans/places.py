"""Queries of the spatial joins, rasters and timetables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import clamp_or_null
from ..operators import raster, running, spatial, transit
from ..sources.fixtures import view, with_views
from .scalar import sql_haversine

QUERIES, ORACLES = {}, {}
ORIGIN, STEP = (27.10, 38.40), (0.0005, 0.0005)
#: Places where journeys start, and the second of the day.
STARTS, DEPART = ((1, 27.115, 38.41), (2, 27.14, 38.43), (3, 27.16, 38.445)), 1200


def _facilities(spark, sf_dir, key="facility_id"):
    return view(spark, sf_dir, "facilities").select(F.col("facility_id").alias(key), "lon", "lat")


def _zones(spark, sf_dir):
    return view(spark, sf_dir, "zones").select("zone_id", "lon", "lat", "population")


_D = sql_haversine("z.lon", "z.lat", "f.lon", "f.lat")
_ZF = with_views("zones", "facilities")
QUERIES["j05_nearest"] = lambda spark, sf_dir: spatial.nearest(_zones(spark, sf_dir), _facilities(spark, sf_dir), "zone_id", "facility_id", 800.0).withColumn("distance_m", F.round("distance_m", 3))
ORACLES["j05_nearest"] = f"{_ZF} SELECT zone_id, arg_min(facility_id, d * 1e9 + facility_id * 1e-3) AS facility_id, round(min(d), 3) AS distance_m FROM (SELECT z.zone_id, f.facility_id, {_D} AS d FROM zones z, facilities f) WHERE d <= 800 GROUP BY 1"


def _stops_near(spark, sf_dir):
    near = spatial.nearest_few(_zones(spark, sf_dir), _facilities(spark, sf_dir), "zone_id", "facility_id", 1500.0, 20)
    return near.select("zone_id", "facility_id", "place", F.round("distance_m", 3).alias("distance_m"))


QUERIES["j07_stops_near"] = _stops_near
ORACLES["j07_stops_near"] = f"{_ZF} SELECT zone_id, facility_id, rn AS place, round(d, 3) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY d, facility_id) AS rn FROM (SELECT z.zone_id, f.facility_id, {_D} AS d FROM zones z, facilities f) WHERE d <= 1500) WHERE rn <= 20"
QUERIES["j08_transfers"] = lambda spark, sf_dir: transit.transfers(_facilities(spark, sf_dir, "stop_id"), 600.0).withColumn("seconds", F.round("seconds", 3))
_FF = sql_haversine("a.lon", "a.lat", "b.lon", "b.lat")
ORACLES["j08_transfers"] = f"{with_views('facilities')} SELECT a AS from_stop, b AS to_stop, round(greatest(60e0, d * 1.3e0 / 1.2e0), 3) AS seconds FROM (SELECT a.facility_id AS a, b.facility_id AS b, {_FF} AS d FROM facilities a, facilities b WHERE a.facility_id <> b.facility_id) WHERE d <= 600"
QUERIES["j09_catchment"] = lambda spark, sf_dir: spatial.within(_zones(spark, sf_dir), _facilities(spark, sf_dir), 1500.0).groupBy("facility_id").agg(F.count("*").alias("zones"), F.round(F.sum("population"), 4).alias("population"))
ORACLES["j09_catchment"] = f"{_ZF} SELECT facility_id, count(*) AS zones, round(sum(population), 4) AS population FROM (SELECT f.facility_id, z.population, {_D} AS d FROM zones z, facilities f) WHERE d <= 1500 GROUP BY 1"


def _od(spark, sf_dir):
    pairs = spatial.place_pairs(_zones(spark, sf_dir), _facilities(spark, sf_dir), "zone_id", "facility_id", None)  # all pairs are what is asked for
    return spatial.spread(pairs.withColumn("distance_m", F.round("distance_m", 3)), "zone_id", "facility_id")


QUERIES["j10_od_pairs"] = _od
ORACLES["j10_od_pairs"] = f"{_ZF} SELECT zone_id, facility_id, round({_D}, 3) AS distance_m FROM zones z, facilities f"


def _zipped(spark, sf_dir):
    return running.zipped(_zones(spark, sf_dir).select("zone_id"), "zone_id", _facilities(spark, sf_dir).select("facility_id"), "facility_id")


QUERIES["j11_positional"] = _zipped
ORACLES["j11_positional"] = f"{_ZF}, a AS (SELECT zone_id, row_number() OVER (ORDER BY zone_id) AS rn FROM zones), b AS (SELECT facility_id, row_number() OVER (ORDER BY facility_id) AS rn FROM facilities) SELECT rn AS pair_id, zone_id, facility_id FROM a JOIN b USING (rn)"


def _as_of(spark, sf_dir):
    ready = _facilities(spark, sf_dir, "stop_id").select("stop_id", F.explode(F.array(*(F.lit(x).cast("long") for x in range(0, 40000, 1777)))).alias("ready"))
    times = view(spark, sf_dir, "stop_times").select(F.col("stop_id").cast("long"), F.col("departure").cast("long"), F.col("trip_id").cast("long"))
    return spatial.as_of_forward(ready, times, "stop_id", "ready", "departure", "trip_id")


QUERIES["j19_next_departure"] = _as_of
ORACLES["j19_next_departure"] = f"{with_views('facilities', 'stop_times')}, r AS (SELECT facility_id AS stop_id, unnest([{', '.join(map(str, range(0, 40000, 1777)))}]) AS ready FROM facilities) SELECT r.stop_id::BIGINT AS stop_id, ready::BIGINT AS ready, min(departure)::BIGINT AS departure, arg_min(trip_id, departure * 10000000 + trip_id)::BIGINT AS trip_id FROM r LEFT JOIN stop_times t ON t.stop_id = r.stop_id AND departure >= ready GROUP BY 1, 2"


def _services(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    calendar = orders.select(F.col("o_orderkey").alias("service_id"), F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), 400).alias("end"), F.filter(F.sequence(F.lit(0), F.lit(6)), lambda d: (F.col("o_orderkey") + d) % 3 != 0).alias("days"))
    exceptions = orders.select(F.col("o_orderkey").alias("service_id"), F.to_date(F.lit("1996-05-15")).alias("date"), (F.col("o_orderkey") % 11 + 1).alias("type"))
    return transit.active_services(calendar, exceptions, "1996-05-15")


QUERIES["j03_active_services"] = _services
ORACLES["j03_active_services"] = "WITH c AS (SELECT o_orderkey AS s FROM orders WHERE DATE '1996-05-15' BETWEEN o_orderdate::DATE AND o_orderdate::DATE + 400 AND (o_orderkey + isodow(DATE '1996-05-15') - 1) % 3 <> 0 AND o_orderkey % 11 <> 1) SELECT s AS service_id FROM c UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0"


def _raptor(spark, sf_dir):
    stops = _facilities(spark, sf_dir, "stop_id")
    starts = spark.createDataFrame(list(STARTS), "query long, lon double, lat double")
    access = spatial.within(starts, stops, 800.0).select("query", "stop_id", (DEPART + F.col("distance_m") / transit.WALK_MS).alias("arrival"))
    found = transit.earliest_arrivals(view(spark, sf_dir, "stop_times"), transit.transfers(stops), access)
    return found.select("query", "stop_id", F.round("arrival", 3).alias("arrival"), "rides")


QUERIES["g18_earliest_arrivals"] = _raptor
_ROUND = """, b{k} AS (SELECT f.q, t.trip_id, min(t.stop_sequence) AS s FROM r{p} f JOIN st t USING (stop_id) WHERE f.rides = {p} AND t.departure >= f.arrival + {wait} GROUP BY 1, 2),
d{k} AS (SELECT q, t.stop_id, min(t.arrival)::DOUBLE AS arrival FROM b{k} JOIN st t ON t.trip_id = b{k}.trip_id AND t.stop_sequence > s GROUP BY 1, 2),
n{k} AS (SELECT q, stop_id, min(arrival) AS arrival, {k} AS rides FROM (SELECT * FROM d{k} UNION ALL SELECT q, b, arrival + seconds FROM d{k} JOIN walks ON a = stop_id) GROUP BY 1, 2),
r{k} AS (SELECT q, stop_id, min(arrival) AS arrival, arg_min(rides, arrival * 10 + rides) AS rides FROM (SELECT * FROM r{p} UNION ALL SELECT * FROM n{k}) GROUP BY 1, 2)"""
ORACLES["g18_earliest_arrivals"] = (
    f"{with_views('facilities', 'stop_times')}, st AS (SELECT * FROM stop_times), walks AS (SELECT a, b, greatest(60e0, d * 1.3e0 / 1.2e0) AS seconds FROM (SELECT a.facility_id AS a, b.facility_id AS b, {_FF} AS d FROM facilities a, facilities b WHERE a.facility_id <> b.facility_id) WHERE d <= 300), starts(q, lon, lat) AS (VALUES {', '.join(f'({q}, {x}::DOUBLE, {y}::DOUBLE)' for q, x, y in STARTS)}), r0 AS (SELECT q, stop_id, {DEPART}e0 + d / 1.2e0 AS arrival, 0 AS rides FROM (SELECT q, b.facility_id AS stop_id, {_FF} AS d FROM starts a, facilities b) WHERE d <= 800)"
    + "".join(_ROUND.format(k=k, p=k - 1, wait=60 if k > 1 else 0) for k in (1, 2, 3, 4))
    + " SELECT q AS query, stop_id, round(arrival, 3) AS arrival, rides FROM r4"
)

# -- rasters ---


def _cells(spark, sf_dir):
    return view(spark, sf_dir, "grid_nodes").select(F.col("j").alias("row"), F.col("i").alias("col"), F.col("dem").alias("value"), "lst", "ndvi")


QUERIES["a21_raster_range"] = lambda spark, sf_dir: _cells(spark, sf_dir).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("cells"))
ORACLES["a21_raster_range"] = with_views("grid_nodes") + " SELECT min(dem) AS low, max(dem) AS high, count(dem) AS cells FROM grid_nodes"


def _sample(spark, sf_dir):
    got = raster.sample(_zones(spark, sf_dir), _cells(spark, sf_dir), ORIGIN, STEP)
    heat = clamp_or_null((F.col("lst") - 20) / 30.0, 0, 1)
    return got.select("zone_id", F.round("value", 6).alias("dem"), F.round(heat, 6).alias("heat"), F.round("ndvi", 6).alias("green"))


_AT = "floor((lon - 27.10e0) / 0.0005e0)::BIGINT AS col, floor((lat - 38.40e0) / 0.0005e0)::BIGINT AS row"
QUERIES["j24_raster_sample"] = _sample
ORACLES["j24_raster_sample"] = f"{with_views('zones', 'grid_nodes')} SELECT zone_id, round(dem, 6) AS dem, CASE WHEN lst IS NULL THEN NULL ELSE round(greatest(0e0, least(1e0, (lst - 20) / 30)), 6) END AS heat, round(ndvi, 6) AS green FROM (SELECT zone_id, {_AT} FROM zones) z LEFT JOIN grid_nodes g ON g.i = z.col AND g.j = z.row"
QUERIES["e01_bicubic"] = lambda spark, sf_dir: raster.bicubic(_zones(spark, sf_dir), _cells(spark, sf_dir), "zone_id", ORIGIN, STEP).select("zone_id", F.round("z", 4).alias("z"), "cells")
_W = "CASE WHEN {a} <= 1 THEN 1.5e0 * pow({a}, 3) - 2.5e0 * {a} * {a} + 1 WHEN {a} < 2 THEN -0.5e0 * pow({a}, 3) + 2.5e0 * {a} * {a} - 4 * {a} + 2 ELSE 0e0 END"
ORACLES["e01_bicubic"] = f"""{with_views('zones', 'grid_nodes')}, q AS (SELECT zone_id, x, y, floor(x)::BIGINT + i AS c, floor(y)::BIGINT + j AS r FROM (SELECT zone_id, (lon - 27.10e0) / 0.0005e0 AS x, (lat - 38.40e0) / 0.0005e0 AS y FROM zones), (SELECT unnest([-1, 0, 1, 2]) AS i), (SELECT unnest([-1, 0, 1, 2]) AS j))
SELECT zone_id, round(sum({_W.format(a='abs(x - c)')} * {_W.format(a='abs(y - r)')} * coalesce(dem, 0)), 4) AS z, count(dem) AS cells FROM q LEFT JOIN grid_nodes g ON g.i = q.c AND g.j = q.r GROUP BY 1"""
QUERIES["a22_friction_surface"] = lambda spark, sf_dir: raster.friction_surface(_cells(spark, sf_dir).withColumn("ndvi", F.when(F.col("row") % 3 != 0, F.col("ndvi"))), {"value": 0.5, "lst": 0.3, "ndvi": 0.2}, ("ndvi",)).select("row", "col", F.round("friction", 6).alias("friction"))
ORACLES["a22_friction_surface"] = with_views("grid_nodes") + ", c AS (SELECT j, i, dem, lst, CASE WHEN j % 3 <> 0 THEN ndvi END AS g FROM grid_nodes), n AS (SELECT j, i, (dem - min(dem) OVER ()) / (max(dem) OVER () - min(dem) OVER ()) AS a, (lst - min(lst) OVER ()) / (max(lst) OVER () - min(lst) OVER ()) AS b, 1 - (g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) AS c FROM c) SELECT j AS row, i AS col, round(CASE WHEN c IS NULL THEN (0.5e0 * a + 0.3e0 * b) / 0.8e0 ELSE 0.5e0 * a + 0.3e0 * b + 0.2e0 * c END, 6) AS friction FROM n"
QUERIES["a29_polygon_area"] = lambda spark, sf_dir: raster.local_area_ha(view(spark, sf_dir, "routes"), "route_id").select("route_id", F.round("area_ha", 3).alias("area_ha"))
ORACLES["a29_polygon_area"] = with_views("routes") + ", f AS (SELECT route_id, seq, lon * k AS x, lat * 110574e0 AS y FROM (SELECT *, cos(radians(avg(lat) OVER (PARTITION BY route_id))) * 111320e0 AS k FROM routes)), n AS (SELECT route_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS xn, coalesce(lead(y) OVER w, first_value(y) OVER w) AS yn FROM f WINDOW w AS (PARTITION BY route_id ORDER BY seq)) SELECT route_id, round(abs(sum(x * yn - xn * y)) / 2 / 10000, 3) AS area_ha FROM n GROUP BY 1"


def _walkability(spark, sf_dir):
    from ..functions.geo import haversine_2d

    edges = view(spark, sf_dir, "grid_segments").withColumn("d", haversine_2d("lon1", "lat1", "lon2", "lat2"))
    slope = 100 * F.abs(F.col("z2") - F.col("z1")) / F.greatest(F.lit(1.0), F.col("d"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - slope / 15 * 80))
    return edges.select("u", "v", F.round("d", 3).alias("length_m"), F.round(slope, 4).alias("slope_pct"), (slope <= 8.33).alias("is_ada_ok"), F.round(score, 4).alias("walk_score"))


QUERIES["a11_walkability"] = _walkability
ORACLES["a11_walkability"] = f"{with_views('grid_segments')} SELECT u, v, round(d, 3) AS length_m, round(s, 4) AS slope_pct, s <= 8.33e0 AS is_ada_ok, round(greatest(0e0, least(100e0, 100 - s / 15 * 80)), 4) AS walk_score FROM (SELECT u, v, d, 100 * abs(z2 - z1) / greatest(1e0, d) AS s FROM (SELECT *, {sql_haversine('lon1', 'lat1', 'lon2', 'lat2')} AS d FROM grid_segments))"


def _compare(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    run = lambda flag, name: lines.where(F.col("l_linestatus") == flag).groupBy((F.col("l_suppkey") % 30 if flag == "O" else F.col("l_suppkey") % 40).alias("profile")).agg(F.avg("l_quantity").alias(name))
    both = run("O", "before").join(run("F", "after"), "profile", "full_outer")
    return both.select("profile", *(F.round(c, 6).alias(c) for c in ("before", "after")), F.round(F.col("after") - F.col("before"), 6).alias("delta"), F.round(100 * (F.col("after") - F.col("before")) / F.nullif("before", F.lit(0.0)), 6).alias("pct"))


QUERIES["j27_compare_runs"] = _compare
ORACLES["j27_compare_runs"] = "WITH a AS (SELECT l_suppkey % 30 AS profile, avg(l_quantity) AS before FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_suppkey % 40 AS profile, avg(l_quantity) AS after FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT profile, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta, round(100 * (after - before) / nullif(before, 0), 6) AS pct FROM a FULL JOIN b USING (profile)"


def _gpx(spark, sf_dir):
    """Tracks written as GPX text, one document each, and parsed back by pattern."""
    point = F.format_string('<trkpt lat="%.6f" lon="%.6f"><ele>%d</ele></trkpt>', "lat", "lon", F.col("seq").cast("int"))
    text = view(spark, sf_dir, "tracks").groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", point.alias("p")))), lambda s: s["p"]), "").alias("gpx"))
    parts = text.select("track_id", F.posexplode(F.regexp_extract_all("gpx", F.lit(r'(<trkpt lat="[^"]*" lon="[^"]*"><ele>[^<]*)'), 1)).alias("k", "p"))
    field = lambda pattern: F.regexp_extract("p", pattern, 1)
    return parts.select("track_id", (F.col("k") + 1).cast("long").alias("seq"), field('lat="([^"]*)"').cast("double").alias("lat"), field('lon="([^"]*)"').cast("double").alias("lon"), field("<ele>(.*)").cast("long").alias("ele"))


QUERIES["s13_gpx_points"] = _gpx
ORACLES["s13_gpx_points"] = with_views("tracks") + " SELECT track_id, seq, round(lat, 6) AS lat, round(lon, 6) AS lon, seq AS ele FROM tracks"


def _ways(spark, sf_dir):
    """Ways as node lists to segments: consecutive pairs joined with both nodes' places, reversed where one-way is -1."""
    nodes = view(spark, sf_dir, "grid_nodes").select("node_id", "lon", "lat")
    ways = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("way")).agg(F.array_sort(F.collect_set("l_partkey")).alias("nodes"))
    pairs = ways.select("way", F.posexplode("nodes").alias("k", "a"), "nodes").select("way", "k", "a", F.get("nodes", F.col("k") + 1).alias("b")).where("b is not null")
    back = F.col("way") % 7 == 0
    pairs = pairs.select("way", "k", F.when(back, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("v"))
    ends = pairs.join(nodes.select(F.col("node_id").alias("u"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1")), "u").join(nodes.select(F.col("node_id").alias("v"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), "v")
    return ends.select("way", "u", "v", F.round(spatial.haversine_2d("lon1", "lat1", "lon2", "lat2"), 3).alias("length_m")).where("length_m >= 0.1")


QUERIES["s02_way_segments"] = _ways
ORACLES["s02_way_segments"] = f"{with_views('grid_nodes')}, n AS (SELECT DISTINCT l_orderkey AS way, l_partkey AS a FROM lineitem), p AS (SELECT way, a, lead(a) OVER (PARTITION BY way ORDER BY a) AS b FROM n), q AS (SELECT way, CASE WHEN way % 7 = 0 THEN b ELSE a END AS u, CASE WHEN way % 7 = 0 THEN a ELSE b END AS v FROM p WHERE b IS NOT NULL) SELECT way, u, v, round(d, 3) AS length_m FROM (SELECT way, u, v, {_FF} AS d FROM q JOIN grid_nodes a ON a.node_id = u JOIN grid_nodes b ON b.node_id = v) WHERE d >= 0.1"
