"""What stands along routes: buildings, trees and parks of a corridor, and the shade that buildings cast."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.context import local_xy
from .corridor import along_routes
from .spatial import within

# Fixed values, in metres: what is added to a corridor's half width for buildings, trees and parks; least distance of a tree from
# the line; room around a building without trees; eye height; longest ray; metres of a degree of latitude of the shade's frame.
BUILDINGS_M, TREES_M, PARKS_M, LEAST_TREE_M, ROOM_M = 15.0, 5.0, 35.0, 1.0, 3.0
EYE_M, RAY_M, DEGREE_M = 1.6, 600.0, 110574.0
CELL_M = 50.0


def _nearest(places: DataFrame, key: str, segments: DataFrame, reach_m: float) -> DataFrame:
    return along_routes(places, key, segments, reach_m).groupBy(key).agg(F.min("distance_m").alias("distance_m"))


def corridor_buildings(buildings: DataFrame, segments: DataFrame, buffer_m: float = 30.0) -> DataFrame:
    """buildings(building_id, lon, lat: the middle) whose middle is within the buffer and BUILDINGS_M of a route, with distance_m."""
    return buildings.join(_nearest(buildings, "building_id", segments, buffer_m + BUILDINGS_M), "building_id")


def corridor_trees(trees: DataFrame, buildings: DataFrame, segments: DataFrame, buffer_m: float = 30.0) -> DataFrame:
    """trees(tree_id, lon, lat) beside a route and clear of buildings(building_id, lon, lat, radius_m), with distance_m."""
    beside = trees.join(_nearest(trees, "tree_id", segments, buffer_m + TREES_M).where(F.col("distance_m") >= LEAST_TREE_M), "tree_id")
    hit = within(beside.select("tree_id", "lon", "lat"), buildings.select("building_id", "lon", "lat", "radius_m"), F.col("radius_m") + ROOM_M, distance="d").where(F.col("d") < F.col("radius_m") + ROOM_M)
    return beside.join(hit.select("tree_id").distinct(), "tree_id", "left_anti")


def tree_parks(trees: DataFrame, parks: DataFrame) -> DataFrame:
    """(tree_id, park_id): the first park(park_id, lon, lat, radius_m) by id whose circle holds the tree; null for none."""
    inside = within(trees.select("tree_id", "lon", "lat"), parks.select("park_id", "lon", "lat", "radius_m"), F.col("radius_m"), distance="d")
    return trees.select("tree_id").join(inside.groupBy("tree_id").agg(F.min("park_id").alias("park_id")), "tree_id", "left")


def corridor_parks(corners: DataFrame, segments: DataFrame, buffer_m: float = 30.0) -> DataFrame:
    """(park_id, distance_m) of parks by corners(park_id, seq from 0, lon, lat): the middle, or one of every n/8-th corners, is near a route."""
    count = F.count("*").over(Window.partitionBy("park_id"))
    sampled = corners.withColumn("each", F.greatest(F.lit(1), F.floor(count / 8))).where("seq % each = 0").select("park_id", "lon", "lat")
    middles = corners.groupBy("park_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    places = sampled.union(middles.select("park_id", "lon", "lat"))
    return _nearest(places, "park_id", segments, buffer_m + PARKS_M)


def shaded(points: DataFrame, key: str, walls: DataFrame, azimuth_deg: float, elevation_deg: float, origin: tuple[float, float]) -> DataFrame:
    """(key, shaded) of points(key, lon, lat): whether a building lies between a point and the sun, or around the point.

    walls(building_id, height_m, lon, lat, lon2, lat2) are the sides of closed rings. A ray of bounded length and the walls are laid
    on cells, so that they meet by an equi-join; a wall in two cells of a ray is met once. Below the horizon all is shade.
    """
    if elevation_deg <= 0:
        return points.select(key, F.lit(True).alias("shaded"))
    tangent, az = math.tan(math.radians(elevation_deg)), math.radians(azimuth_deg)
    highest = walls.agg(F.max("height_m")).first()[0] or 0.0
    reach = min(RAY_M, (highest - EYE_M) / tangent)
    if reach <= 0:
        return points.select(key, F.lit(False).alias("shaded"))
    dx, dy = math.sin(az), math.cos(az)
    x, y = local_xy("lon", "lat", F.lit(origin[0]), F.lit(origin[1]), DEGREE_M)
    x2, y2 = local_xy("lon2", "lat2", F.lit(origin[0]), F.lit(origin[1]), DEGREE_M)
    cell = lambda c: F.floor(c / CELL_M).cast("long")
    span = lambda a, b: F.sequence(cell(F.least(a, b)), cell(F.greatest(a, b)))
    rays = points.select(key, x.alias("px"), y.alias("py"))
    steps = math.ceil(reach / (CELL_M / 2))
    along = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct(cell(F.col("px") + i * (dx * reach / steps)).alias("cx"), cell(F.col("py") + i * (dy * reach / steps)).alias("cy")))
    around = F.flatten(F.transform(along, lambda c: F.array(*(F.struct((c["cx"] + i).alias("cx"), (c["cy"] + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))))
    rays = rays.select(key, "px", "py", F.explode(F.array_distinct(around)).alias("c")).select(key, "px", "py", "c.*")
    sides = walls.select("building_id", "height_m", x.alias("x1"), y.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    placed = sides.withColumn("cx", F.explode(span(F.col("x1"), F.col("x2")))).withColumn("cy", F.explode(span(F.col("y1"), F.col("y2"))))
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    denominator = dx * ey - dy * ex
    t = ((F.col("x1") - F.col("px")) * ey - (F.col("y1") - F.col("py")) * ex) / denominator
    u = ((F.col("x1") - F.col("px")) * dy - (F.col("y1") - F.col("py")) * dx) / denominator
    behind = (F.abs(denominator) >= 1e-12) & (t > 0) & (u >= 0) & (u <= 1) & (F.col("height_m") - EYE_M > t * tangent)
    met = rays.join(placed, ["cx", "cy"]).groupBy(key).agg(F.max(F.coalesce(behind, F.lit(False))).alias("behind"))
    # Inside a ring an eastward line crosses an odd number of its sides; rings near a point are those whose box holds it.
    boxes = sides.groupBy("building_id").agg(F.min("x1").alias("w"), F.max("x1").alias("e"), F.min("y1").alias("s"), F.max("y1").alias("n"))
    boxes = boxes.withColumn("cx", F.explode(span(F.col("w"), F.col("e")))).withColumn("cy", F.explode(span(F.col("s"), F.col("n"))))
    homes = points.select(key, x.alias("px"), y.alias("py")).withColumns({"cx": cell(F.col("px")), "cy": cell(F.col("py"))})
    near = homes.join(boxes, ["cx", "cy"]).where("px between w and e and py between s and n").select(key, "px", "py", "building_id")
    crosses = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("x1") + (F.col("py") - F.col("y1")) * ex / F.nullif(ey, F.lit(0.0)) > F.col("px"))
    inside = near.join(sides, "building_id").groupBy(key, "building_id").agg((F.count_if(crosses) % 2 == 1).alias("in")).groupBy(key).agg(F.max("in").alias("inside"))
    found = points.select(key).join(met, key, "left").join(inside, key, "left")
    return found.select(key, (F.coalesce("behind", F.lit(False)) | F.coalesce("inside", F.lit(False))).alias("shaded"))


def named_lines(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """pairs(origin, destination, ...) with the coordinates of their names; pairs of one name, or of unknown ones, go."""
    ends = lambda n: places.select(F.col("name").alias(n), F.col("lon").alias(f"{n}_lon"), F.col("lat").alias(f"{n}_lat"))
    return pairs.where("origin <> destination").join(ends("origin"), "origin").join(ends("destination"), "destination")


