"""Queries of relief: slopes, hillshade, planes, thinning and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.context import local_xy
from ..operators import relief
from ..sources.fixtures import view, with_views
from .scalar import sql_haversine

QUERIES, ORACLES = {}, {}
SPACING_M = 80.0
CELL_M = (43.6, 55.3)


def _aspects(spark, sf_dir):
    rows = view(spark, sf_dir, "grid_segments").withColumn("z1", F.when(F.col("code") % 7 != 0, F.col("z1"))).withColumn("lon2", F.when(F.col("code") == 5, F.col("lon1")).otherwise(F.col("lon2"))).withColumn("lat2", F.when(F.col("code") == 5, F.col("lat1")).otherwise(F.col("lat2")))
    slope, aspect, light = relief.slope_and_aspect("lon1", "lat1", "z1", "lon2", "lat2", "z2")
    return rows.select("u", "v", F.round(slope, 5).alias("slope_pct"), F.round(aspect, 4).alias("aspect_deg"), F.round(light, 5).alias("light"))


QUERIES["k19_slope_aspect"] = _aspects
_LIT = "greatest(0e0, least(1e0, cos(t) * sin(e) + sin(t) * cos(e) * cos(radians(180e0 - aspect))))"
ORACLES["k19_slope_aspect"] = f"""{with_views('grid_segments')}, s AS (SELECT u, v, CASE WHEN code % 7 <> 0 THEN z1 END AS z1, z2, lon1, lat1, CASE WHEN code = 5 THEN lon1 ELSE lon2 END AS lon2, CASE WHEN code = 5 THEN lat1 ELSE lat2 END AS lat2 FROM grid_segments),
d AS (SELECT *, {sql_haversine('lon1', 'lat1', 'lon2', 'lat2')} AS d, fmod(degrees(atan2((lon2 - lon1) * cos(radians((lat1 + lat2) * 0.5e0)), lat2 - lat1)) + 360e0, 360e0) AS b FROM s),
k AS (SELECT *, d >= 0.1 AND z1 IS NOT NULL AS ok FROM d), a AS (SELECT u, v, d, ok, CASE WHEN ok THEN (z2 - z1) / d * 100 ELSE 0 END AS slope, CASE WHEN ok THEN b ELSE 0 END AS aspect FROM k),
l AS (SELECT *, atan(abs(slope) / 100e0) AS t, radians(55e0) AS e FROM a)
SELECT u, v, round(slope, 5) AS slope_pct, round(aspect, 4) AS aspect_deg, round(CASE WHEN d < 0.1 THEN 0.5e0 WHEN NOT ok THEN 1e0 ELSE {_LIT} END, 5) AS light FROM l"""

QUERIES["k27_hillshade"] = lambda spark, sf_dir: relief.hillshade(view(spark, sf_dir, "grid_nodes").select("i", "j", F.when(F.col("node_id") % 17 != 3, F.col("z")).alias("value")), *CELL_M, side=16).select("i", "j", F.round("shade", 6).alias("shade"))
_N = "coalesce({t}.h, g.h)"
ORACLES["k27_hillshade"] = f"""{with_views('grid_nodes')}, g AS (SELECT i, j, z AS h FROM grid_nodes WHERE node_id % 17 <> 3),
n AS (SELECT g.i, g.j, ({_N.format(t='e')} - {_N.format(t='w')}) / (2 * {CELL_M[0]}e0) * 5 AS sx, ({_N.format(t='n')} - {_N.format(t='s')}) / (2 * {CELL_M[1]}e0) * 5 AS sy
 FROM g LEFT JOIN g e ON e.i = g.i + 1 AND e.j = g.j LEFT JOIN g w ON w.i = g.i - 1 AND w.j = g.j LEFT JOIN g n ON n.i = g.i AND n.j = g.j + 1 LEFT JOIN g s ON s.i = g.i AND s.j = g.j - 1)
SELECT i, j, round(greatest(0e0, (0.5e0 * sx - 0.5e0 * sy + sqrt(0.5e0)) / sqrt(sx * sx + sy * sy + 1)), 6) AS shade FROM n"""


def _local(df, *keep):
    x, y = local_xy("lon", "lat", F.lit(27.10), F.lit(38.40), 110574.0)
    return df.withColumns({"x": x, "y": y}).select(*keep, "x", "y")


def _heights(spark, sf_dir):
    """Heights 60 m beside the first point of every route, from the route's own points."""
    routes = view(spark, sf_dir, "routes")
    spots = _local(routes.where("seq = 1"), "route_id").withColumn("y", F.col("y") + 60.0).withColumn("spot", F.col("route_id"))
    return relief.blended_heights(spots, "spot", _local(routes, "route_id", "z"), "route_id").select(F.col("spot").alias("route_id"), F.round("z", 5).alias("z"))


QUERIES["a38_blended_height"] = _heights
_XY = "(lon - 27.10e0) * 111320e0 * cos(radians(38.40e0)) AS x, (lat - 38.40e0) * 110574e0 AS y"
ORACLES["a38_blended_height"] = f"""{with_views('routes')}, p AS (SELECT route_id, seq, z, {_XY} FROM routes),
m AS (SELECT route_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p GROUP BY 1),
q AS (SELECT route_id, sum((x - mx) * (x - mx)) AS xx, sum((y - my) * (y - my)) AS yy, sum((x - mx) * (y - my)) AS xy, sum((x - mx) * (z - mz)) AS xz, sum((y - my) * (z - mz)) AS yz FROM p JOIN m USING (route_id) GROUP BY 1),
g AS (SELECT m.*, CASE WHEN abs(xx * yy - xy * xy) > 1e-4 THEN (xz * yy - yz * xy) / (xx * yy - xy * xy) ELSE 0 END AS gx, CASE WHEN abs(xx * yy - xy * xy) > 1e-4 THEN (yz * xx - xz * xy) / (xx * yy - xy * xy) ELSE 0 END AS gy FROM m JOIN q USING (route_id)),
s AS (SELECT route_id, x, y + 60 AS y FROM p WHERE seq = 1), d AS (SELECT s.route_id, any_value(s.x) AS x, any_value(s.y) AS y, min(sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2))) AS least,
 sum(p.z / pow(greatest(10e0, sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2))), 1.6e0)) / sum(1 / pow(greatest(10e0, sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2))), 1.6e0)) AS local FROM s JOIN p USING (route_id) GROUP BY 1),
b AS (SELECT *, greatest(0e0, least(1e0, (least - 20) / 60e0)) AS blend FROM d)
SELECT route_id, round((1 - blend) * local + blend * (mz + gx * (x - mx) + gy * (y - my)), 5) AS z FROM b JOIN g USING (route_id)"""

QUERIES["j17_thinned_points"] = lambda spark, sf_dir: relief.thinned(view(spark, sf_dir, "zones").select("zone_id", "lon", "lat"), "zone_id", SPACING_M)
ORACLES["j17_thinned_points"] = f"""{with_views('zones')}, z AS (SELECT zone_id, lon, lat, row_number() OVER (ORDER BY zone_id) AS i FROM zones), adj AS (SELECT a.i AS a, b.i AS b FROM z a JOIN z b ON b.i < a.i AND abs(a.lat - b.lat) < 0.001 WHERE {sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} < {SPACING_M}),
k(i, ok) USING KEY (i) AS (SELECT i, TRUE AS ok FROM z WHERE i NOT IN (SELECT a FROM adj) UNION
 SELECT a, NOT met FROM (SELECT adj.a, coalesce(bool_or(r.ok), FALSE) AS met, count_if(r.i IS NULL) AS waiting FROM (SELECT count(*) AS c FROM k) new JOIN adj ON c > 0 LEFT JOIN recurring.k r ON r.i = adj.b LEFT JOIN recurring.k q ON q.i = adj.a WHERE q.i IS NULL GROUP BY 1) WHERE met OR waiting = 0)
SELECT zone_id FROM z JOIN k USING (i) WHERE ok"""

_DIGITS = ("cast(round(lon * 100000) as bigint)", "cast(round(lat * 100000) as bigint)", "cast(round(z * 100) as bigint)")
QUERIES["a39_ordered_digest"] = lambda spark, sf_dir: relief.ordered_digest(view(spark, sf_dir, "routes"), "route_id", "seq", list(_DIGITS))
ORACLES["a39_ordered_digest"] = f"{with_views('routes')} SELECT route_id, count(*) AS n, (sum(('0x' || substr(md5(concat_ws('|', seq::VARCHAR, {', '.join(f'({d})::VARCHAR' for d in _DIGITS)})), 1, 15))::BIGINT::HUGEINT) % 1152921504606846976)::BIGINT AS digest FROM routes GROUP BY 1"
