"""OpenStreetMap elements as JSON, one element a line or one array of them: streets, buildings and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.access import road_rank, speed_limit_kmh
from ..functions.geo import haversine_2d

ELEMENT = "type string, id long, lon double, lat double, nodes array<long>, tags map<string, string>"
# Metres of a storey; height and storeys where none is tagged; height of a tree where none is.
STOREY_M, HEIGHT_M, STOREYS, TREE_M = 3.2, 12.0, 4, 8.0
PLAIN = ("name", "access", "foot", "bicycle", "lit", "sidewalk")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of JSON files, each one document with an `elements` array."""
    return spark.read.schema(f"elements array<struct<{ELEMENT.replace(' ', ': ').replace(',: ', ', ')}>>").json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")


def parse_elements(lines: DataFrame, column: str = "value") -> DataFrame:
    """Elements of a text column that holds one element's JSON a row."""
    return lines.select(F.from_json(column, ELEMENT).alias("e")).select("e.*")


def _tag(name: str, default: str = "") -> Column:
    return F.coalesce(F.element_at("tags", name), F.lit(default))


def street_segments(elements: DataFrame) -> DataFrame:
    """Segments between consecutive nodes of ways, in the direction of travel: way_id, seq, u, v, their ends and tags.

    Nodes without finite coordinates, unknown nodes and segments of less than 0.1 m go. oneway=-1 turns a way round; a roundabout is
    one-way; `vehicle` stands in for a missing motor_vehicle tag.
    """
    nodes = elements.where("type = 'node' and not isnan(lon + lat) and abs(lon + lat) < double('Infinity')").select(F.col("id").alias("node"), "lon", "lat").dropDuplicates(["node"])
    oneway = F.lower(F.trim(_tag("oneway")))
    turned = oneway.isin("-1", "reverse")
    highway = _tag("highway", "residential")
    lanes = F.greatest(F.lit(1), F.coalesce(F.element_at("tags", "lanes").try_cast("int"), F.lit(1)))
    tags = {
        "highway": highway, "rank": road_rank(highway), "is_steps": highway == "steps", "surface": _tag("surface", "asphalt"), "lanes": lanes,
        "oneway": oneway.isin("yes", "1", "true") | turned | (F.lower(F.trim(_tag("junction"))) == "roundabout"), "turned": turned,
        "motor_vehicle": F.trim(F.coalesce(F.element_at("tags", "motor_vehicle"), F.element_at("tags", "vehicle"), F.lit(""))),
        "maxspeed_kmh": speed_limit_kmh(F.element_at("tags", "maxspeed")), "oneway_bicycle": F.trim(_tag("oneway:bicycle")), "oneway_foot": F.trim(_tag("oneway:foot")),
        **{k: F.trim(_tag(k)) for k in PLAIN},
    }
    ways = elements.where("type = 'way'").select(F.col("id").alias("way_id"), F.posexplode("nodes").alias("seq", "node"), *(c.alias(k) for k, c in tags.items()))
    ways = ways.withColumn("after", F.lead("node").over(Window.partitionBy("way_id").orderBy("seq"))).where("after is not null")
    ends = lambda a, b: nodes.select(F.col("node").alias(a), F.col("lon").alias(f"lon_{b}"), F.col("lat").alias(f"lat_{b}"))
    met = ways.join(ends("node", "a"), "node").join(ends("after", "b"), "after")
    met = met.withColumn("length_m", haversine_2d("lon_a", "lat_a", "lon_b", "lat_b")).where("length_m >= 0.1")
    pick = lambda a, b: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a))
    return met.select("way_id", "seq", pick("node", "after").alias("u"), pick("after", "node").alias("v"), pick("lon_a", "lon_b").alias("lon1"), pick("lat_a", "lat_b").alias("lat1"), pick("lon_b", "lon_a").alias("lon2"), pick("lat_b", "lat_a").alias("lat2"), "length_m", *(k for k in tags if k != "turned"))


def _metres(name: str) -> Column:
    return F.trim(F.replace(F.element_at("tags", name), F.lit("m"), F.lit(""))).try_cast("double")


def buildings(elements: DataFrame) -> DataFrame:
    """building_id, height_m, levels, kind, estimated of ways tagged as building: storeys first, then a height of 3 m at least, else a default."""
    storeys, height = F.floor(F.element_at("tags", "building:levels").try_cast("double")), _metres("height")
    tagged = F.element_at("tags", "building:levels").isNotNull()
    least = lambda x, low: F.when(x.isNotNull(), F.greatest(F.lit(low), x))
    storeys, height = least(storeys, 1), least(height, 3.0)
    levels = F.coalesce(F.when(tagged, storeys).otherwise(least(F.floor(height / STOREY_M), 1)), F.lit(STOREYS))
    metres = F.coalesce(F.when(tagged, storeys * STOREY_M).otherwise(height), F.lit(HEIGHT_M))
    rows = elements.where("type = 'way' and map_contains_key(tags, 'building')")
    return rows.select(F.col("id").alias("building_id"), metres.cast("double").alias("height_m"), levels.cast("int").alias("levels"), F.element_at("tags", "building").alias("kind"), (~tagged & F.element_at("tags", "height").isNull()).alias("estimated"))


def trees(elements: DataFrame) -> DataFrame:
    """tree_id, lon, lat, species, kind, height_m, canopy_m, estimated of nodes tagged natural=tree."""
    within = lambda x, low, high: F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))
    height = F.coalesce(within(_metres("height"), 3.0, 35.0), F.lit(TREE_M))
    canopy = F.coalesce(within(_metres("diameter_crown") * 0.5, 1.5, 10.0), within(height * 0.38, 1.5, 8.0))
    species = F.coalesce(F.element_at("tags", "species"), F.element_at("tags", "genus"), F.element_at("tags", "taxon"), F.lit("tree"))
    leaf = F.lower(_tag("leaf_type"))
    needles = leaf.contains("needle") | leaf.contains("conifer") | F.lower(species).contains("pine")
    rows = elements.where("type = 'node' and tags['natural'] = 'tree' and lon <> 0 and lat <> 0")
    return rows.select(F.col("id").alias("tree_id"), "lon", "lat", species.alias("species"), F.when(needles, "conifer").otherwise("deciduous").alias("kind"), height.alias("height_m"), canopy.alias("canopy_m"), (F.element_at("tags", "height").isNull() & F.element_at("tags", "diameter_crown").isNull()).alias("estimated"))
