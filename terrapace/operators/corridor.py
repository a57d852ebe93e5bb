"""What lies along a route: distances to its line, buffers, hazards, cells and shade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON
from ..functions.solar import solar_position, street_shaded
from .spatial import cell_at, cells_near


def line_segments(points: DataFrame) -> DataFrame:
    """Consecutive pairs of points(route_id, seq, lon, lat, z)."""
    w = Window.partitionBy("route_id").orderBy("seq")
    return points.select("route_id", "seq", "lon", "lat", "z", *(F.lead(c).over(w).alias(f"{c}2") for c in ("lon", "lat", "z"))).where("lon2 is not null")


def distance_to_segment(x: str, y: str) -> tuple[Column, Column]:
    """(metres, place along it from 0 to 1) from a point to the segment lon, lat - lon2, lat2, in a frame at the point's latitude."""
    k = F.cos(F.radians(F.col(y))) * METRES_PER_DEGREE_LON
    ax, ay = (F.col("lon") - F.col(x)) * k, (F.col("lat") - F.col(y)) * METRES_PER_DEGREE_LAT
    bx, by = (F.col("lon2") - F.col(x)) * k, (F.col("lat2") - F.col(y)) * METRES_PER_DEGREE_LAT
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length))).otherwise(0.0)
    return F.hypot(ax + t * dx, ay + t * dy), t


def along_routes(assets: DataFrame, key: str, segments: DataFrame, reach_m: float) -> DataFrame:
    """(key, route_id, distance_m): assets(key, lon, lat) at most reach_m from a route's line, by the nearest segment.

    Segments are offered to every cell that their box, widened by the reach, touches; the join is on cells.
    """
    ends = (F.least("lon", "lon2"), F.greatest("lon", "lon2"), F.least("lat", "lat2"), F.greatest("lat", "lat2"))
    offered = segments.withColumn("cell", F.explode(cells_near(*ends, reach_m, 4 * reach_m)))
    placed = assets.select(key, F.col("lon").alias("alon"), F.col("lat").alias("alat")).withColumn("cell", cell_at("alon", "alat", 4 * reach_m))
    near = placed.join(offered, "cell").withColumn("d", distance_to_segment("alon", "alat")[0]).where(F.col("d") <= reach_m)
    return near.groupBy(key, "route_id").agg(F.min("d").alias("distance_m"))


def hazard_exposure(points: DataFrame, hazards: DataFrame) -> DataFrame:
    """Risk of each route: for every hazard(hazard_id, lon, lat, radius_m, severity) that it enters, (radius - least distance) x severity."""
    from .spatial import haversine_2d

    hazards = hazards.withColumnsRenamed({"lon": "hlon", "lat": "hlat"})
    near = points.crossJoin(F.broadcast(hazards)).withColumn("d", haversine_2d("lon", "lat", "hlon", "hlat"))  # hazards are a short list entered by hand
    least = near.groupBy("route_id", "hazard_id").agg(F.min("d").alias("d"), F.first("radius_m").alias("radius_m"), F.first("severity").alias("severity"))
    return least.groupBy("route_id").agg(F.sum(F.greatest(F.lit(0.0), F.col("radius_m") - F.col("d")) * F.col("severity")).alias("risk"), F.min("d").alias("nearest_m"))


def buffer_cells(segments: DataFrame, buffer_m: float) -> DataFrame:
    """(route_id, area_ha): cells of a fifth of the buffer whose centre lies within it of the line, each counted once.

    Cells are bits of words of 8 x 8, so a task holds a word for each of these, not a row for each cell.
    """
    size = buffer_m / 5.0
    x, y = (lambda c: F.col(c) * METRES_PER_DEGREE_LON * 0.78), (lambda c: F.col(c) * METRES_PER_DEGREE_LAT)
    flat = segments.select("route_id", x("lon").alias("x1"), y("lat").alias("y1"), x("lon2").alias("x2"), y("lat2").alias("y2"))
    span = lambda a, b: F.sequence(F.floor((F.least(F.col(a), F.col(b)) - buffer_m) / size).cast("long"), F.floor((F.greatest(F.col(a), F.col(b)) + buffer_m) / size).cast("long"))
    cells = flat.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
    cx, cy = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((cx - F.col("x1")) * dx + (cy - F.col("y1")) * dy) / length))).otherwise(0.0)
    inside = cells.where(F.hypot(F.col("x1") + t * dx - cx, F.col("y1") + t * dy - cy) <= buffer_m)
    bit = F.expr("shiftleft(1L, cast(pmod(cx, 8) * 8 + pmod(cy, 8) as int))")
    words = inside.groupBy("route_id", F.floor(F.col("cx") / 8).alias("wx"), F.floor(F.col("cy") / 8).alias("wy")).agg(F.bit_or(bit).alias("cells"))
    return words.groupBy("route_id").agg((F.sum(F.bit_count("cells")) * size * size / 1e4).alias("area_ha"))


def shade_exposure(points: DataFrame, hour: float = 14.0, day: int = 172, density: float = 0.6) -> DataFrame:
    """Per route: shares of its length in sun and shade by the bearing of its streets, energy of the sun, and a class."""
    from ..functions.geo import haversine_2d

    mean = F.avg("lat").over(Window.partitionBy("route_id"))
    sun = solar_position("mean_lat", F.lit(float(hour)), F.lit(day))
    rows = line_segments(points.withColumn("mean_lat", mean)).join(points.groupBy("route_id").agg(F.avg("lat").alias("mean_lat")), "route_id").withColumn("sun", sun)
    rows = rows.withColumns({"d": haversine_2d("lon", "lat", "lon2", "lat2"), "shaded": street_shaded("lon", "lat", "lon2", "lat2", F.col("sun.azimuth_deg"), F.col("sun.elevation_deg"), density)})
    sums = rows.groupBy("route_id").agg(F.sum("d").alias("length_m"), F.sum(F.when(F.col("shaded"), F.col("d")).otherwise(0.0)).alias("shade_m"), F.first("sun.irradiance").alias("watts"))
    shade = F.when(F.col("length_m") > 0, F.col("shade_m") / F.col("length_m") * 100).otherwise(100.0)
    kind = F.when(F.col("sun_pct") > 65, "Exposed").when(F.col("sun_pct") > 35, "Mixed").otherwise("Shaded")
    out = sums.withColumn("shade_pct", shade).withColumn("sun_pct", 100 - F.col("shade_pct"))
    return out.select("route_id", "sun_pct", "shade_pct", (F.col("watts") * F.col("sun_pct") / 100 * (F.col("length_m") / 1000 * 0.2) / 1000).alias("solar_kwh"), kind.alias("comfort"))


def evacuation(routes: DataFrame, points: DataFrame, pairs: DataFrame, hazards: DataFrame) -> DataFrame:
    """The muster of each origin with the least minutes + risk / 60 over routes(pair_id, cost in seconds).

    points: the routes' points (route_id = pair_id); pairs(pair_id, origin, muster). Ties go to the smaller muster.
    """
    risk = hazard_exposure(points, hazards).select(F.col("route_id").alias("pair_id"), "risk", "nearest_m")
    rows = routes.join(pairs, "pair_id").join(risk, "pair_id", "left").withColumn("minutes", F.col("cost") / 60)
    score = F.struct((F.col("minutes") + F.coalesce("risk", F.lit(0.0)) / 60).alias("total"), "muster", "minutes", F.coalesce("risk", F.lit(0.0)).alias("risk"), F.coalesce("nearest_m", F.lit(9999.0)).alias("clearance_m"))
    return rows.groupBy("origin").agg(F.min(score).alias("best")).select("origin", "best.muster", "best.minutes", "best.risk", "best.clearance_m")
