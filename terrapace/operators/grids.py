"""Elevation grids: a cell size from a budget of points, cells by ranges, clipped to a corridor by a join on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corridor import distance_to_segment
from .spatial import cell_at, cells_near

# Metres of a degree, the finest cell and the usual one in degrees, and the fewest cells of a side.
METRES_PER_DEGREE, FINEST, USUAL, FEWEST = 111_320.0, 0.00005, 0.000277777777778, 8
#: A cell grows by this factor until the grid fits its budget; the longest side of the earth with the finest cells takes fewer than 2048 steps, the sum of HALVES and one.
GROWTH, HALVES = 1.01, tuple(1 << k for k in reversed(range(11)))


def extents(points: DataFrame, key: str, buffer_m: float = 0.0) -> DataFrame:
    """(key, west, south, east, north): the boxes around points(key, lon, lat) with a place, and buffer_m on every side."""
    known = points.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat) and abs(lon) < double('infinity') and abs(lat) < double('infinity')")
    box = known.groupBy(key).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    up = F.lit(buffer_m / METRES_PER_DEGREE)
    side = up / F.greatest(F.lit(0.05), F.cos(F.radians((F.col("south") + F.col("north")) / 2.0)))
    return box.select(key, (F.col("west") - side).alias("west"), (F.col("south") - up).alias("south"), (F.col("east") + side).alias("east"), (F.col("north") + up).alias("north"))


def plans(boxes: DataFrame, resolution_deg: float = USUAL, max_points: int = 25_000) -> DataFrame:
    """boxes(west, south, east, north, ...) with res_deg, res_m, width, height, points and coarsened.

    Cells are resolution_deg wide, or wider, where the box would take more than max_points (at least 64) of them. A side has FEWEST cells
    at least, and a box no side of 0: a place has a grid too. Sides may be given in either order.
    """
    low, high = lambda a, b: F.least(a, b), lambda a, b: F.greatest(a, b)
    boxes = boxes.withColumns({"west": low("west", "east"), "east": high("west", "east"), "south": low("south", "north"), "north": high("south", "north")})
    lon, lat = (F.greatest(F.lit(1e-9), F.col(b) - F.col(a)) for a, b in (("west", "east"), ("south", "north")))
    finest, budget = max(FINEST, float(resolution_deg)), max(64, int(max_points))
    first = F.when((lon / finest) * (lat / finest) > budget, F.sqrt(lon * lat / budget)).otherwise(finest)
    cells = lambda side, res: F.greatest(F.lit(FEWEST).cast("long"), F.ceil(side / res))
    size = lambda k: F.col("__first") * F.pow(F.lit(GROWTH), k)
    fits = lambda k: (cells(lon, size(k)) * cells(lat, size(k)) <= budget) | ((cells(lon, size(k)) <= FEWEST) & (cells(lat, size(k)) <= FEWEST))
    grown = boxes.withColumn("__first", first)
    # What fits keeps fitting as it grows, so the first size that fits is found by halves.
    grown = grown.withColumn("res_deg", F.when(fits(F.lit(0)), F.col("__first")).otherwise(size(1 + F.aggregate(F.array(*map(F.lit, HALVES)), F.lit(0), lambda k, step: F.when(fits(k + step), k).otherwise(k + step)))))
    middle = F.radians((F.col("south") + F.col("north")) / 2.0)
    grown = grown.withColumns({"width": cells(lon, F.col("res_deg")), "height": cells(lat, F.col("res_deg")), "res_m": F.col("res_deg") * METRES_PER_DEGREE * F.sqrt(F.greatest(F.lit(0.05), F.cos(middle)))})
    return grown.withColumns({"points": F.col("width") * F.col("height"), "coarsened": F.col("res_deg") > resolution_deg * 1.0001}).drop("__first")


def cells(plan: DataFrame, key: str) -> DataFrame:
    """(key, row, col, lon, lat): the centres of the cells of plans(), row 0 in the north; the grid starts at its south-western corner. Rows are dealt out before they are cut into cells."""
    rows = plan.select(key, "west", "south", "res_deg", "width", "height", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("row")).repartition(key, "row")
    spots = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("col"))
    north = F.col("south") + F.col("height") * F.col("res_deg")
    return spots.select(key, "row", "col", (F.col("west") + (F.col("col") + 0.5) * F.col("res_deg")).alias("lon"), (north - (F.col("row") + 0.5) * F.col("res_deg")).alias("lat"))


def in_corridor(cells: DataFrame, key: str, segments: DataFrame, buffer_m: float) -> DataFrame:
    """The cells whose centre is at most buffer_m from one of the segments(route_id, lon, lat, lon2, lat2) of their own key (= route_id).

    Spark takes exploded rows for as few as their source's and would broadcast them, so the join is told to sort; a cell stops at its first near segment.
    """
    ends = (F.least("lon", "lon2"), F.greatest("lon", "lon2"), F.least("lat", "lat2"), F.greatest("lat", "lat2"))
    offered = segments.select(F.col("route_id").alias("__key"), "lon", "lat", "lon2", "lat2").withColumn("__at", F.explode(cells_near(*ends, buffer_m, 4 * buffer_m)))
    placed = cells.withColumnsRenamed({"lon": "alon", "lat": "alat"}).withColumn("__cell", cell_at("alon", "alat", 4 * buffer_m))
    near = (F.col(key) == F.col("__key")) & (F.col("__cell") == F.col("__at")) & (distance_to_segment("alon", "alat")[0] <= buffer_m)
    return placed.join(offered.hint("merge"), near, "left_semi").drop("__cell").withColumnsRenamed({"alon": "lon", "alat": "lat"})
