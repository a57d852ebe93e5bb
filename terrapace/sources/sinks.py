"""Routes as text for other programs: GeoJSON features, GPX tracks, tables of origins and destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _line(points: DataFrame, one) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("seq", one.alias("p"))))
    return points.groupBy("route_id").agg(F.transform(ordered, lambda s: s["p"]).alias("line"))


def geojson(points: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """(route_id, feature): a LineString of points(route_id, seq, lon, lat, z), at 6, 6 and 2 decimals, with the columns of properties."""
    line = _line(points, F.array(F.round("lon", 6), F.round("lat", 6), F.round("z", 2)))
    extra = [c for c in properties.columns if c != "route_id"] if properties is not None else []
    rows = line.join(properties, "route_id", "left") if extra else line
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates")).alias("geometry"), F.struct(F.col("route_id"), *extra).alias("properties"))
    return rows.select("route_id", F.to_json(feature).alias("feature"))


def gpx(points: DataFrame, creator: str = "terrapace") -> DataFrame:
    """(route_id, gpx): a GPX 1.1 track of each route."""
    point = F.format_string('<trkpt lat="%.6f" lon="%.6f"><ele>%.2f</ele></trkpt>', "lat", "lon", F.col("z").cast("double"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>'
    return _line(points, point).select("route_id", F.concat(F.lit(head), F.array_join("line", ""), F.lit("</trkseg></trk></gpx>")).alias("gpx"))


OD_DECIMALS = {"distance_km": 3, "minutes": 2, "climb_m": 1}


def od_text(name: str, value: Column) -> Column:
    """A column of the table of origins and destinations, as text."""
    return F.format_string(f"%.{OD_DECIMALS[name]}f", value).alias(name)


def od_table(matrix: DataFrame) -> DataFrame:
    """Text columns of matrix(origin, destination, distance_km, minutes, climb_m) at 3, 2 and 1 decimals."""
    return matrix.select("origin", "destination", *(od_text(c, F.col(c)) for c in OD_DECIMALS))
