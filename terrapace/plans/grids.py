"""Queries of elevation grids: one per route, and the part of it along the route."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corridor, grids, raster
from ..sources.fixtures import view, with_views

QUERIES, ORACLES = {}, {}
FINE, BUDGET, BUFFER_M = 0.00005, 1000, 30.0


def _plan(spark, sf_dir):
    boxes = grids.extents(view(spark, sf_dir, "routes").select("route_id", "lon", "lat"), "route_id", 60.0)
    return grids.plans(boxes, FINE, BUDGET).select("route_id", "width", "height", "points", "coarsened", *(F.round(c, n).alias(c) for c, n in (("west", 8), ("north", 8), ("res_deg", 9), ("res_m", 4))))


def _dem(spark, sf_dir):
    """Heights of the cells within BUFFER_M of each track, read off the grid's raster."""
    tracks = view(spark, sf_dir, "tracks").select(F.col("track_id").alias("route_id"), "seq", "lon", "lat", F.lit(0.0).alias("z"))
    cells = grids.cells(grids.plans(grids.extents(tracks, "route_id", 60.0), FINE, BUDGET), "route_id")
    kept = grids.in_corridor(cells, "route_id", corridor.line_segments(tracks), BUFFER_M).withColumnsRenamed({"row": "grid_row", "col": "grid_col"})
    surface = view(spark, sf_dir, "grid_nodes").select(F.col("i").alias("col"), F.col("j").alias("row"), "dem")
    found = raster.sample(kept, surface, (27.09975, 38.39975), (0.0005, 0.0005))
    return found.select("route_id", "grid_row", "grid_col", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), "dem")


QUERIES["s17_grid_plan"] = _plan
QUERIES["e06_corridor_dem"] = _dem
_PLAN = """{views}, b0 AS (SELECT {key} AS route_id, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM {table} GROUP BY 1),
b AS (SELECT route_id, w - dx AS west, s - dy AS south, e + dx AS east, n + dy AS north FROM (SELECT *, 60 / 111320e0 AS dy, 60 / 111320e0 / greatest(0.05e0, cos(radians((s + n) / 2))) AS dx FROM b0)),
f AS (SELECT *, CASE WHEN ((east - west) / {fine}) * ((north - south) / {fine}) > {budget} THEN sqrt((east - west) * (north - south) / {budget}) ELSE {fine} END AS r0 FROM b),
k AS (SELECT *, CASE WHEN k = 0 THEN r0 ELSE r0 * pow(1.01e0, k) END AS res, greatest(8, ceil((east - west) / (CASE WHEN k = 0 THEN r0 ELSE r0 * pow(1.01e0, k) END))::BIGINT) AS width, greatest(8, ceil((north - south) / (CASE WHEN k = 0 THEN r0 ELSE r0 * pow(1.01e0, k) END))::BIGINT) AS height FROM f, (SELECT unnest(range(0, 200)) AS k)),
plan AS (SELECT route_id, arg_min(struct_pack(west, south, north, res, width, height), k) AS p FROM k WHERE width * height <= {budget} GROUP BY 1)"""
_FIXED = dict(fine=f"{FINE:.5f}::DOUBLE", budget=BUDGET)
ORACLES["s17_grid_plan"] = (
    _PLAN.format(views=with_views("routes"), key="route_id", table="routes", **_FIXED)
    + f" SELECT route_id, p.width AS width, p.height AS height, p.width * p.height AS points, p.res > {FINE * 1.0001} AS coarsened, round(p.west, 8) AS west, round(p.north, 8) AS north, round(p.res, 9) AS res_deg, round(p.res * 111320e0 * sqrt(greatest(0.05e0, cos(radians((p.south + p.north) / 2)))), 4) AS res_m FROM plan"
)
ORACLES["e06_corridor_dem"] = (
    _PLAN.format(views=with_views("grid_nodes", "tracks"), key="track_id", table="tracks", **_FIXED)
    + f""", r AS (SELECT route_id, p, unnest(range(0, p.height)) AS grid_row FROM plan), c AS (SELECT route_id, p, grid_row, unnest(range(0, p.width)) AS grid_col FROM r),
x AS (SELECT route_id, grid_row, grid_col, p.west + (grid_col + 0.5e0) * p.res AS lon, p.south + p.height * p.res - (grid_row + 0.5e0) * p.res AS lat FROM c),
seg AS (SELECT * FROM (SELECT track_id AS route_id, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY seq)) WHERE lon2 IS NOT NULL),
q AS (SELECT x.*, (s.lon - x.lon) * cos(radians(x.lat)) * 111320e0 AS ax, (s.lat - x.lat) * 110574e0 AS ay, (s.lon2 - s.lon) * cos(radians(x.lat)) * 111320e0 AS dx, (s.lat2 - s.lat) * 110574e0 AS dy FROM x JOIN seg s USING (route_id)),
d AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0e0, least(1e0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM q),
kept AS (SELECT DISTINCT route_id, grid_row, grid_col, lon, lat FROM d WHERE sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) <= {BUFFER_M})
SELECT route_id, grid_row, grid_col, round(kept.lon, 8) AS lon, round(kept.lat, 8) AS lat, dem FROM kept LEFT JOIN grid_nodes g ON g.i = floor((kept.lon - 27.09975e0) / 0.0005e0) AND g.j = floor((kept.lat - 38.39975e0) / 0.0005e0)"""
)
