"""Queries of what lies along routes, and of the per-group kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corridor, tours
from ..sources import sinks
from ..sources.fixtures import view, with_views
from .scalar import sql_haversine

QUERIES, ORACLES = {}, {}
REACH = 30.0

# Fixed by the caller: centre, radius in metres, severity.
HAZARDS = ((1, 27.1025, 38.4035, 400.0, 100.0), (2, 27.1075, 38.4075, 250.0, 100.0))


def _tracks(spark, sf_dir):
    return view(spark, sf_dir, "tracks").select(F.col("track_id").alias("route_id"), "seq", "lon", "lat", F.lit(0.0).alias("z"))


def _along(spark, sf_dir):
    assets = view(spark, sf_dir, "grid_nodes").select("node_id", "lon", "lat")
    found = corridor.along_routes(assets, "node_id", corridor.line_segments(_tracks(spark, sf_dir)), REACH)
    return found.select("node_id", "route_id", F.round("distance_m", 3).alias("distance_m"))


_SEGMENTS = f"{with_views('grid_nodes', 'tracks')}, seg AS (SELECT * FROM (SELECT track_id AS route_id, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY seq)) WHERE lon2 IS NOT NULL)"
QUERIES["j13_corridor_assets"] = _along
ORACLES["j13_corridor_assets"] = f"""{_SEGMENTS},
p AS (SELECT node_id, route_id, (s.lon - n.lon) * k AS ax, (s.lat - n.lat) * 110574e0 AS ay, (s.lon2 - s.lon) * k AS dx, (s.lat2 - s.lat) * 110574e0 AS dy FROM (SELECT *, cos(radians(lat)) * 111320e0 AS k FROM grid_nodes) n JOIN seg s ON least(s.lat, s.lat2) - 0.0004 <= n.lat AND greatest(s.lat, s.lat2) + 0.0004 >= n.lat),
q AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0e0, least(1e0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM p)
SELECT node_id, route_id, round(min(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))), 3) AS distance_m FROM q GROUP BY 1, 2 HAVING min(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))) <= 30"""
QUERIES["j26_hazard_exposure"] = lambda spark, sf_dir: corridor.hazard_exposure(view(spark, sf_dir, "routes"), spark.createDataFrame(list(HAZARDS), "hazard_id int, lon double, lat double, radius_m double, severity double")).select("route_id", F.round("risk", 2).alias("risk"), F.round("nearest_m", 3).alias("nearest_m"))
ORACLES["j26_hazard_exposure"] = f"{with_views('routes')}, h(hazard_id, lon, lat, radius_m, severity) AS (VALUES {', '.join(str((a, *(float(x) for x in b))).replace('.0,', '.0::DOUBLE,') for a, *b in HAZARDS)}), d AS (SELECT route_id, hazard_id, any_value(radius_m) AS r, any_value(severity) AS s, min({sql_haversine('z.lon', 'z.lat', 'h.lon', 'h.lat')}) AS d FROM routes z, h GROUP BY 1, 2) SELECT route_id, round(sum(greatest(0e0, r - d) * s), 2) AS risk, round(min(d), 3) AS nearest_m FROM d GROUP BY 1"
QUERIES["a27_corridor_area"] = lambda spark, sf_dir: corridor.buffer_cells(corridor.line_segments(_tracks(spark, sf_dir)), 50.0).select("route_id", F.round("area_ha", 2).alias("area_ha"))
ORACLES["a27_corridor_area"] = f"""{_SEGMENTS},
f AS (SELECT DISTINCT route_id, lon * 111320e0 * 0.78e0 AS x1, lat * 110574e0 AS y1, lon2 * 111320e0 * 0.78e0 AS x2, lat2 * 110574e0 AS y2 FROM seg),
c AS (SELECT *, unnest(range(floor((least(x1, x2) - 50) / 10)::BIGINT, floor((greatest(x1, x2) + 50) / 10)::BIGINT + 1)) AS cx FROM f),
d AS (SELECT *, unnest(range(floor((least(y1, y2) - 50) / 10)::BIGINT, floor((greatest(y1, y2) + 50) / 10)::BIGINT + 1)) AS cy FROM c),
e AS (SELECT *, (cx + 0.5e0) * 10 AS px, (cy + 0.5e0) * 10 AS py, pow(x2 - x1, 2) + pow(y2 - y1, 2) AS l FROM d),
g AS (SELECT *, CASE WHEN l > 0 THEN greatest(0e0, least(1e0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / l)) ELSE 0 END AS t FROM e)
SELECT route_id, round(count(*) * 0.01e0, 2) AS area_ha FROM (SELECT DISTINCT route_id, cx, cy FROM g WHERE sqrt(pow(x1 + t * (x2 - x1) - px, 2) + pow(y1 + t * (y2 - y1) - py, 2)) <= 50) GROUP BY 1"""
QUERIES["a24_shade_exposure"] = lambda spark, sf_dir: corridor.shade_exposure(view(spark, sf_dir, "routes"), density=0.9).select("route_id", *(F.round(c, 4).alias(c) for c in ("sun_pct", "shade_pct", "solar_kwh")), "comfort")
ORACLES["a24_shade_exposure"] = f"""{with_views('routes')}, m AS (SELECT route_id, radians(avg(lat)) AS la, radians(23.45e0 * sin(radians(360e0 / 365e0 * 456))) AS dec FROM routes GROUP BY 1),
s AS (SELECT route_id, el, CASE WHEN el > 0 THEN radians(360e0 - degrees(acos(greatest(-1e0, least(1e0, (sin(dec) - sin(la) * sin(el)) / greatest(0.001e0, cos(la) * cos(el))))))) ELSE pi() END AS az FROM (SELECT *, asin(sin(la) * sin(dec) + cos(la) * cos(dec) * cos(radians(30e0))) AS el FROM m)),
g AS (SELECT * FROM (SELECT route_id, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM routes WINDOW w AS (PARTITION BY route_id ORDER BY seq)) WHERE lon2 IS NOT NULL),
h AS (SELECT g.route_id, el, {sql_haversine('lon', 'lat', 'lon2', 'lat2')} AS d, sin(abs(atan2((lon2 - lon) * cos(radians((lat + lat2) * 0.5e0)), lat2 - lat) - az) % (pi() / 2)) * 0.9e0 * least(1e0, 0.35e0 / greatest(0.1e0, tan(el))) > 0.45e0 AS shaded FROM g JOIN s USING (route_id)),
t AS (SELECT route_id, any_value(el) AS el, sum(d) AS l, sum(CASE WHEN shaded THEN d ELSE 0 END) AS sh FROM h GROUP BY 1), u AS (SELECT *, CASE WHEN l > 0 THEN sh / l * 100 ELSE 100e0 END AS p FROM t)
SELECT route_id, round(100 - p, 4) AS sun_pct, round(p, 4) AS shade_pct, round(1000 * sin(el) * (100 - p) / 100 * (l / 1000 * 0.2e0) / 1000, 4) AS solar_kwh, CASE WHEN 100 - p > 65 THEN 'Exposed' WHEN 100 - p > 35 THEN 'Mixed' ELSE 'Shaded' END AS comfort FROM u"""
QUERIES["t07_visiting_order"] = lambda spark, sf_dir: tours.tours(view(spark, sf_dir, "routes").select(F.col("route_id").alias("tour_id"), "seq", "lon", "lat"))
QUERIES["a28_convex_hull"] = lambda spark, sf_dir: tours.hulls(view(spark, sf_dir, "routes").select(F.col("route_id").alias("id"), "lon", "lat"))
QUERIES["w01_geojson"] = lambda spark, sf_dir: sinks.geojson(view(spark, sf_dir, "routes")).select("route_id", F.get_json_object("feature", "$.geometry.type").alias("kind"), F.json_array_length(F.get_json_object("feature", "$.geometry.coordinates")).cast("long").alias("points"), F.round(F.get_json_object("feature", "$.geometry.coordinates[0][0]").cast("double"), 6).alias("lon"))
ORACLES["w01_geojson"] = with_views("routes") + " SELECT route_id, 'LineString' AS kind, count(*) AS points, round(arg_min(lon, seq), 6) AS lon FROM routes GROUP BY 1"
QUERIES["w02_gpx"] = lambda spark, sf_dir: sinks.gpx(view(spark, sf_dir, "routes")).select("route_id", "gpx")
ORACLES["w02_gpx"] = with_views("routes") + """ SELECT route_id, '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="terrapace" xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>' || string_agg(printf('<trkpt lat="%.6f" lon="%.6f"><ele>%.2f</ele></trkpt>', lat, lon, z), '' ORDER BY seq) || '</trkseg></trk></gpx>' AS gpx FROM routes GROUP BY 1"""
