"""Queries of what stands along routes, of snapping and reached streets, and of feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assets, network, search
from ..operators.corridor import line_segments
from ..sources import gtfs, osm
from ..sources.fixtures import view, with_views
from .corridor import _SEGMENTS, _tracks
from .network import _EDGES, _PATHS, _STARTS, _WALK, BANDS, _costed, _origins
from .scalar import sql_haversine

QUERIES, ORACLES = {}, {}
C = F.col
#: Derived things by the numbers of grid nodes, as SQL that both engines read.
BUILDINGS = "SELECT node_id AS building_id, lon + 0.00005e0 AS lon, lat + 0.0001e0 AS lat, 2e0 + node_id % 7 AS radius_m, 6e0 + node_id % 20 AS height_m FROM grid_nodes WHERE node_id % 3 = 0"
TREES = "SELECT node_id AS tree_id, lon - 0.0004e0 AS lon, lat + (node_id % 5) * 0.00005e0 AS lat FROM grid_nodes WHERE node_id % 3 = 1"
PARKS = "SELECT node_id AS park_id, lon, lat, 120e0 AS radius_m FROM grid_nodes WHERE node_id % 50 = 2"
SIDES = ((-1, -1, 1, -1), (1, -1, 1, 1), (1, 1, -1, 1), (-1, 1, -1, -1))
HALF = 0.00006


def _made(spark, sf_dir, text):
    return spark.sql(text.replace("FROM grid_nodes", "FROM {grid_nodes}"), grid_nodes=view(spark, sf_dir, "grid_nodes"))


def _lines(spark, sf_dir):
    return line_segments(_tracks(spark, sf_dir))


def _near(name: str, key: str) -> str:
    """Ways of SQL to the least distance of a table's places from the tracks."""
    return f"""{name}_p AS (SELECT {key}, (s.lon - n.lon) * k AS ax, (s.lat - n.lat) * 110574e0 AS ay, (s.lon2 - s.lon) * k AS dx, (s.lat2 - s.lat) * 110574e0 AS dy FROM (SELECT *, cos(radians(lat)) * 111320e0 AS k FROM {name}) n JOIN (SELECT DISTINCT lon, lat, lon2, lat2 FROM seg) s ON least(s.lat, s.lat2) - 0.0008 <= n.lat AND greatest(s.lat, s.lat2) + 0.0008 >= n.lat),
{name}_q AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0e0, least(1e0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM {name}_p),
{name}_d AS (SELECT {key}, min(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))) AS d FROM {name}_q GROUP BY 1)"""


_ALL = f"{_SEGMENTS}, buildings AS ({BUILDINGS}), trees AS ({TREES}), parks AS ({PARKS})"
QUERIES["j14_corridor_buildings"] = lambda spark, sf_dir: assets.corridor_buildings(_made(spark, sf_dir, BUILDINGS), _lines(spark, sf_dir)).select("building_id", F.round("distance_m", 3).alias("distance_m"))
ORACLES["j14_corridor_buildings"] = f"{_ALL}, {_near('buildings', 'building_id')} SELECT building_id, round(d, 3) AS distance_m FROM buildings_d WHERE d <= 45"


def _trees(spark, sf_dir):
    buildings = assets.corridor_buildings(_made(spark, sf_dir, BUILDINGS), _lines(spark, sf_dir))
    return assets.corridor_trees(_made(spark, sf_dir, TREES), buildings, _lines(spark, sf_dir))


_CLEAR = f"{_ALL}, {_near('buildings', 'building_id')}, {_near('trees', 'tree_id')}, b AS (SELECT * FROM buildings JOIN buildings_d USING (building_id) WHERE d <= 45), kept AS (SELECT t.*, d FROM trees t JOIN trees_d USING (tree_id) WHERE d BETWEEN 1 AND 35 AND NOT EXISTS (SELECT 1 FROM b WHERE abs(b.lat - t.lat) < 0.0002 AND {sql_haversine('t.lon', 't.lat', 'b.lon', 'b.lat')} < b.radius_m + 3))"
QUERIES["j16_corridor_trees"] = lambda spark, sf_dir: _trees(spark, sf_dir).select("tree_id", F.round("distance_m", 3).alias("distance_m"))
ORACLES["j16_corridor_trees"] = f"{_CLEAR} SELECT tree_id, round(d, 3) AS distance_m FROM kept"
QUERIES["j18_tree_parks"] = lambda spark, sf_dir: assets.tree_parks(_trees(spark, sf_dir), _made(spark, sf_dir, PARKS))
ORACLES["j18_tree_parks"] = f"{_CLEAR} SELECT tree_id, min(park_id) AS park_id FROM kept t LEFT JOIN parks p ON {sql_haversine('t.lon', 't.lat', 'p.lon', 'p.lat')} <= p.radius_m GROUP BY 1"
_CORNER = "SELECT park_id, {seq} AS seq, lon + {x} * 0.0003e0 AS lon, lat + {y} * 0.0003e0 AS lat FROM parks"
_CORNERS = " UNION ALL ".join(_CORNER.format(seq=k, x=x, y=y) for k, (x, y) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))


def _parks(spark, sf_dir):
    corners = spark.sql(_CORNERS.replace("FROM parks", "FROM {parks}"), parks=_made(spark, sf_dir, PARKS))
    return assets.corridor_parks(corners, _lines(spark, sf_dir)).select("park_id", F.round("distance_m", 3).alias("distance_m"))


QUERIES["j15_corridor_parks"] = _parks
ORACLES["j15_corridor_parks"] = f"{_ALL}, corners AS ({_CORNERS}), spots AS (SELECT park_id, lon, lat FROM corners UNION ALL SELECT park_id, avg(lon), avg(lat) FROM corners GROUP BY 1), {_near('spots', 'park_id')} SELECT park_id, round(d, 3) AS distance_m FROM spots_d WHERE d <= 65"
AZIMUTH, ELEVATION = 135.0, 30.0


def _shade(spark, sf_dir):
    sides = F.array(*(F.struct(*((C(c) + d * HALF).alias(n) for n, c, d in zip(("lon", "lat", "lon2", "lat2"), ("lon", "lat", "lon", "lat"), side))) for side in SIDES))
    walls = _made(spark, sf_dir, BUILDINGS).select("building_id", "height_m", F.explode(sides).alias("w")).select("building_id", "height_m", "w.*")
    return assets.shaded(_made(spark, sf_dir, TREES).union(_made(spark, sf_dir, BUILDINGS).select((-C("building_id") - 1).alias("tree_id"), "lon", "lat")), "tree_id", walls, AZIMUTH, ELEVATION, (27.1, 38.4))


QUERIES["j22_building_shade"] = _shade
ORACLES["j22_building_shade"] = f"""{_ALL}, o(ax, ay, bx, bz) AS (VALUES {', '.join(map(str, SIDES))}),
m AS (SELECT 111320e0 * cos(radians(38.4e0)) AS kx, sin(radians({AZIMUTH}e0)) AS dx, cos(radians({AZIMUTH}e0)) AS dy, tan(radians({ELEVATION}e0)) AS tn),
w AS (SELECT building_id, height_m, (lon + ax * 0.00006e0 - 27.1e0) * kx AS x1, (lat + ay * 0.00006e0 - 38.4e0) * 110574e0 AS y1, (lon + bx * 0.00006e0 - 27.1e0) * kx AS x2, (lat + bz * 0.00006e0 - 38.4e0) * 110574e0 AS y2 FROM buildings, o, m),
p AS (SELECT tree_id, (lon - 27.1e0) * kx AS px, (lat - 38.4e0) * 110574e0 AS py, dx, dy, tn FROM (SELECT tree_id, lon, lat FROM trees UNION ALL SELECT -building_id - 1, lon, lat FROM buildings), m),
r AS (SELECT tree_id, building_id, height_m, tn, ((x1 - px) * (y2 - y1) - (y1 - py) * (x2 - x1)) / nullif(dx * (y2 - y1) - dy * (x2 - x1), 0) AS t, ((x1 - px) * dy - (y1 - py) * dx) / nullif(dx * (y2 - y1) - dy * (x2 - x1), 0) AS u,
 (y1 > py) <> (y2 > py) AND x1 + (py - y1) * (x2 - x1) / nullif(y2 - y1, 0) > px AS crosses FROM p JOIN w ON abs(x1 - px) < 200 AND abs(y1 - py) < 200),
h AS (SELECT tree_id, building_id, bool_or(t > 0 AND u BETWEEN 0 AND 1 AND height_m - 1.6e0 > t * tn) AS behind, count_if(crosses) % 2 = 1 AS inside FROM r GROUP BY 1, 2),
s AS (SELECT tree_id, bool_or(coalesce(behind, FALSE) OR inside) AS shaded FROM h GROUP BY 1) SELECT tree_id, coalesce(shaded, FALSE) AS shaded FROM p LEFT JOIN s USING (tree_id)"""


def _desire(spark, sf_dir):
    places = view(spark, sf_dir, "facilities").select(F.concat(F.lit("f"), C("facility_id").cast("string")).alias("name"), "lon", "lat")
    name = lambda c: F.concat(F.lit("f"), (C(c) % 110).cast("string"))
    pairs = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", name("o_custkey").alias("origin"), name("o_orderkey").alias("destination"))
    return assets.named_lines(pairs, places)


QUERIES["j28_desire_lines"] = _desire
ORACLES["j28_desire_lines"] = with_views("facilities") + ", n AS (SELECT 'f' || facility_id AS name, lon, lat FROM facilities), q AS (SELECT o_orderkey, 'f' || (o_custkey % 110) AS origin, 'f' || (o_orderkey % 110) AS destination FROM orders) SELECT o_orderkey, origin, destination, a.lon AS origin_lon, a.lat AS origin_lat, b.lon AS destination_lon, b.lat AS destination_lat FROM q JOIN n a ON a.name = origin JOIN n b ON b.name = destination WHERE origin <> destination"


def _snap(spark, sf_dir):
    facilities = view(spark, sf_dir, "facilities").select(C("facility_id").alias("f"), C("lon").alias("lon_d"), C("lat").alias("lat_d"))
    zones = view(spark, sf_dir, "zones").select(C("zone_id").alias("pair_id"), (C("zone_id") % 10).alias("f"), C("lon").alias("lon_o"), C("lat").alias("lat_o"))
    nodes = view(spark, sf_dir, "grid_nodes").select(C("node_id").alias("node"), "lon", "lat", ((C("i") + 2 * C("j")) % 5).alias("component"))
    return network.compatible_snap(zones.join(facilities, "f"), nodes, 70.0)


QUERIES["j06_compatible_snap"] = _snap
ORACLES["j06_compatible_snap"] = f"""{with_views('zones', 'facilities', 'grid_nodes')}, n AS (SELECT node_id AS node, lon, lat, (i + 2 * j) % 5 AS component FROM grid_nodes), sizes AS (SELECT component, count(*) AS size FROM n GROUP BY 1),
p AS (SELECT zone_id AS pair_id, z.lon AS lon_o, z.lat AS lat_o, f.lon AS lon_d, f.lat AS lat_d FROM zones z JOIN facilities f ON f.facility_id = z.zone_id % 10),
near AS (SELECT pair_id, e, component, min(struct_pack(d := d, node := node)) AS x FROM (SELECT pair_id, e, component, node, {sql_haversine('q.lon', 'q.lat', 'n.lon', 'n.lat')} AS d FROM (SELECT pair_id, 'o' AS e, lon_o AS lon, lat_o AS lat FROM p UNION ALL SELECT pair_id, 'd', lon_d, lat_d FROM p) q JOIN n ON abs(n.lat - q.lat) < 0.001) WHERE d <= 70 GROUP BY 1, 2, 3),
b AS (SELECT a.pair_id, min(struct_pack(t := a.x.d + c.x.d, s := -size, o := a.x.node, d := c.x.node)) AS m FROM near a JOIN near c ON c.pair_id = a.pair_id AND c.component = a.component AND a.e = 'o' AND c.e = 'd' JOIN sizes ON sizes.component = a.component GROUP BY 1),
one AS (SELECT pair_id, min(x) FILTER (e = 'o') AS o, min(x) FILTER (e = 'd') AS d FROM near GROUP BY 1)
SELECT p.pair_id, coalesce(m.o, one.o.node) AS node_o, coalesce(m.d, one.d.node) AS node_d, m IS NOT NULL AS shared FROM p LEFT JOIN b USING (pair_id) LEFT JOIN one USING (pair_id)"""


def _pieces(spark, sf_dir):
    edges = _costed(spark, sf_dir, "adult", True)
    times = search.shortest_paths(edges, _origins(spark, sf_dir), BANDS[0] * 60.0)
    return network.reached_pieces(times, edges, BANDS[0] * 60.0).select("origin", "u", "v", F.round("fraction", 6).alias("fraction"))


QUERIES["a26_reached_pieces"] = _pieces
ORACLES["a26_reached_pieces"] = _PATHS.format(edges=_EDGES, cost=_WALK, starts=_STARTS, limit=f"{BANDS[0] * 60}e0") + f", g AS (SELECT o, u, v, least(1e0, ({BANDS[0] * 60}e0 - paths.c) / w.c) AS f FROM paths JOIN w ON w.u = paths.node WHERE paths.c < {BANDS[0] * 60}e0) SELECT o AS origin, u, v, round(f, 6) AS fraction FROM g a WHERE NOT (v < u AND f >= 1 AND EXISTS (SELECT 1 FROM g b WHERE b.o = a.o AND b.u = a.v AND b.v = a.u AND b.f >= 1))"

# -- feeds

_WAY = {"highway": "CASE j % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'steps' WHEN 2 THEN 'residential' END", "oneway": "CASE j % 5 WHEN 0 THEN '-1' WHEN 1 THEN 'Yes' END", "junction": "CASE WHEN j % 7 = 0 THEN 'roundabout' END", "lanes": "CASE j % 3 WHEN 0 THEN '3' WHEN 1 THEN 'many' END", "maxspeed": "CASE j % 3 WHEN 0 THEN '30 mph' WHEN 1 THEN '50' END", "vehicle": "CASE WHEN j % 6 = 0 THEN 'no' END", "name": "CASE WHEN j % 2 = 0 THEN 'Street ' || j END"}


def _osm(spark, sf_dir):
    """Rows of the grid as ways, every tenth node unknown, written as JSON and read back."""
    grid = view(spark, sf_dir, "grid_nodes")
    nodes = grid.where("node_id % 10 <> 9").select(F.to_json(F.struct(F.lit("node").alias("type"), C("node_id").alias("id"), "lon", "lat")).alias("value"))
    ways = grid.groupBy("j").agg(F.array_sort(F.collect_list("node_id")).alias("nodes"))
    tags = F.map_filter(F.create_map(*(x for k, v in _WAY.items() for x in (F.lit(k), F.expr(v)))), lambda k, v: v.isNotNull())
    ways = ways.select(F.to_json(F.struct(F.lit("way").alias("type"), C("j").alias("id"), "nodes", tags.alias("tags"))).alias("value"))
    found = osm.street_segments(osm.parse_elements(nodes.union(ways)))
    return found.select("way_id", "seq", "u", "v", F.round("length_m", 4).alias("length_m"), "highway", "rank", "is_steps", "lanes", "oneway", "motor_vehicle", F.round("maxspeed_kmh", 4).alias("maxspeed_kmh"), "name", "surface")


QUERIES["s02_osm_json"] = _osm
ORACLES["s02_osm_json"] = f"""{with_views('grid_nodes')}, t AS (SELECT node_id, lon, lat, j, lead(node_id) OVER w AS after, row_number() OVER w - 1 AS seq, {', '.join(f'{v} AS {k}' for k, v in _WAY.items())} FROM grid_nodes WINDOW w AS (PARTITION BY j ORDER BY node_id)),
m AS (SELECT t.*, {sql_haversine('t.lon', 't.lat', 'b.lon', 'b.lat')} AS d FROM t JOIN grid_nodes b ON b.node_id = after WHERE t.node_id % 10 <> 9 AND after % 10 <> 9)
SELECT j AS way_id, seq, CASE WHEN oneway = '-1' THEN after ELSE node_id END AS u, CASE WHEN oneway = '-1' THEN node_id ELSE after END AS v, round(d, 4) AS length_m, coalesce(highway, 'residential') AS highway, CASE highway WHEN 'primary' THEN 2 WHEN 'steps' THEN 5 ELSE 4 END AS rank, coalesce(highway = 'steps', FALSE) AS is_steps,
 CASE lanes WHEN '3' THEN 3 ELSE 1 END AS lanes, oneway IS NOT NULL OR junction IS NOT NULL AS oneway, coalesce(vehicle, '') AS motor_vehicle, CASE maxspeed WHEN '50' THEN 50e0 WHEN '30 mph' THEN round(30 * 1.609344e0, 4) END AS maxspeed_kmh, coalesce(name, '') AS name, 'asphalt' AS surface FROM m"""
_HOUSE = {"building": "CASE WHEN p_partkey % 2 = 0 THEN 'yes' ELSE 'house' END", "building:levels": "CASE p_partkey % 5 WHEN 0 THEN cast(p_size AS string) WHEN 1 THEN 'x' END", "height": "CASE p_partkey % 3 WHEN 0 THEN p_size / 4e0 || ' m' WHEN 1 THEN cast(p_size AS string) END"}


def _houses(spark, sf_dir):
    tags = F.map_filter(F.create_map(*(x for k, v in _HOUSE.items() for x in (F.lit(k), F.expr(v)))), lambda k, v: v.isNotNull())
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.to_json(F.struct(F.lit("way").alias("type"), C("p_partkey").alias("id"), tags.alias("tags"))).alias("value"))
    return osm.buildings(osm.parse_elements(lines)).withColumn("height_m", F.round("height_m", 4))


QUERIES["s07_osm_buildings"] = _houses
ORACLES["s07_osm_buildings"] = "WITH p AS (SELECT p_partkey, p_size, p_partkey % 5 < 2 AS tagged, CASE p_partkey % 5 WHEN 0 THEN greatest(1, p_size) END AS l, CASE p_partkey % 3 WHEN 0 THEN greatest(3e0, p_size / 4e0) WHEN 1 THEN greatest(3e0, p_size) END AS h FROM part) SELECT p_partkey AS building_id, round(CASE WHEN tagged THEN coalesce(l * 3.2e0, 12e0) ELSE coalesce(h, 12e0) END, 4) AS height_m, (CASE WHEN tagged THEN coalesce(l, 4) WHEN h IS NULL THEN 4 ELSE greatest(1, floor(h / 3.2e0)) END)::INT AS levels, CASE WHEN p_partkey % 2 = 0 THEN 'yes' ELSE 'house' END AS kind, NOT tagged AND p_partkey % 3 = 2 AS estimated FROM p"


def _trees_of(spark, sf_dir):
    tags = {"natural": "'tree'", "height": "CASE p_partkey % 3 WHEN 0 THEN p_size || 'm' END", "diameter_crown": "CASE p_partkey % 4 WHEN 0 THEN cast(p_size / 2e0 AS string) END", "species": "CASE p_partkey % 5 WHEN 0 THEN 'Stone Pine' WHEN 1 THEN 'oak' END", "leaf_type": "CASE p_partkey % 7 WHEN 0 THEN 'Needleleaved' END"}
    made = F.map_filter(F.create_map(*(x for k, v in tags.items() for x in (F.lit(k), F.expr(v)))), lambda k, v: v.isNotNull())
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.to_json(F.struct(F.lit("node").alias("type"), C("p_partkey").alias("id"), (C("p_partkey") * 0.001).alias("lon"), F.lit(38.4).alias("lat"), made.alias("tags"))).alias("value"))
    return osm.trees(osm.parse_elements(lines)).select("tree_id", "species", "kind", F.round("height_m", 4).alias("height_m"), F.round("canopy_m", 4).alias("canopy_m"), "estimated")


QUERIES["s07_osm_trees"] = _trees_of
ORACLES["s07_osm_trees"] = "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN greatest(3e0, least(35e0, p_size)) ELSE 8e0 END AS h, CASE WHEN p_partkey % 4 = 0 THEN greatest(1.5e0, least(10e0, p_size / 4e0)) END AS c FROM part WHERE p_partkey <> 0) SELECT p_partkey AS tree_id, CASE p_partkey % 5 WHEN 0 THEN 'Stone Pine' WHEN 1 THEN 'oak' ELSE 'tree' END AS species, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN 'conifer' ELSE 'deciduous' END AS kind, h AS height_m, round(coalesce(c, greatest(1.5e0, least(8e0, h * 0.38e0))), 4) AS canopy_m, p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AS estimated FROM p"


def _feed(spark, sf_dir):
    """A feed derived from the timetable: route and service by the trip's number, some times blank, some stops stations."""
    times = view(spark, sf_dir, "stop_times")
    text = lambda c: F.format_string("%d:%02d:%02d", F.floor(C(c) / 3600), F.floor(C(c) / 60) % 60, C(c) % 60)
    stop_times = times.select(C("trip_id").cast("string").alias("trip_id"), C("stop_id").cast("string").alias("stop_id"), C("stop_sequence").cast("string").alias("stop_sequence"), F.when(C("stop_id") % 5 != 0, text("arrival")).alias("arrival_time"), F.when(C("stop_id") % 3 != 0, text("departure")).otherwise(" ").alias("departure_time"))
    trips = times.select("trip_id").distinct().select(C("trip_id").cast("string").alias("trip_id"), (C("trip_id") % 9).cast("string").alias("route_id"), (C("trip_id") % 4).cast("string").alias("service_id"))
    stops = view(spark, sf_dir, "facilities").select(C("facility_id").cast("string").alias("stop_id"), F.lit(None).cast("string").alias("stop_name"), C("lon").cast("string").alias("stop_lon"), C("lat").cast("string").alias("stop_lat"), F.when(C("facility_id") % 10 == 7, "1").otherwise("").alias("location_type"))
    running = spark.createDataFrame([("0",), ("2",), ("3",)], "service_id string")
    found = gtfs.patterns(gtfs.running_times(stop_times, trips, gtfs.boarding_stops(stops), running))
    return found.select("trip_id", "route_id", F.array_join("stops", ",").alias("stops"), C("departure").cast("long").alias("departure"), "place")


QUERIES["s11_gtfs_patterns"] = _feed
ORACLES["s11_gtfs_patterns"] = f"""{with_views('stop_times', 'facilities')}, t AS (SELECT trip_id, stop_sequence, stop_id, CASE WHEN stop_id % 3 <> 0 THEN departure ELSE arrival END AS dep FROM stop_times JOIN facilities ON facility_id = stop_id WHERE trip_id % 4 <> 1 AND stop_id % 10 <> 7 AND NOT (stop_id % 5 = 0 AND stop_id % 3 = 0)),
g AS (SELECT trip_id, string_agg(stop_id::VARCHAR, ',' ORDER BY stop_sequence) AS stops, first(dep ORDER BY stop_sequence) AS departure FROM t GROUP BY 1 HAVING count(*) >= 2)
SELECT trip_id::VARCHAR AS trip_id, (trip_id % 9)::VARCHAR AS route_id, stops, departure::BIGINT AS departure, row_number() OVER (PARTITION BY trip_id % 9, stops ORDER BY departure, trip_id::VARCHAR) - 1 AS place FROM g"""
