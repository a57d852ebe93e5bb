"""Queries of choices among alternatives, masks and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import node_cell
from ..operators import choices, spatial
from ..sources import sinks
from ..sources.fixtures import view, with_views
from .scalar import sql_haversine

QUERIES, ORACLES = {}, {}


def _solutions(spark, sf_dir):
    """Order lines as alternatives of their order: four objectives each."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    number = F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)")
    return lines.select(F.col("l_orderkey").alias("query"), number.cast("long").alias("alt"), (F.col("l_quantity") * 7).alias("time_s"), (F.col("l_partkey") % 50).cast("double").alias("ascent_m"), F.col("l_discount").alias("heat"), (F.col("l_suppkey") % 20).cast("double").alias("kcal"))


_S = "WITH s AS (SELECT l_orderkey AS query, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS alt, l_quantity * 7 AS time_s, (l_partkey % 50)::DOUBLE AS ascent_m, l_discount AS heat, (l_suppkey % 20)::DOUBLE AS kcal FROM lineitem)"
QUERIES["u06_skyline"] = lambda spark, sf_dir: choices.skyline(_solutions(spark, sf_dir), "query", "alt", ["time_s", "ascent_m", "heat", "kcal"]).select("query", "alt")
ORACLES["u06_skyline"] = _S + " SELECT query, alt FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.query = a.query AND b.time_s <= a.time_s AND b.ascent_m <= a.ascent_m AND b.heat <= a.heat AND b.kcal <= a.kcal AND (b.time_s < a.time_s OR b.ascent_m < a.ascent_m OR b.heat < a.heat OR b.kcal < a.kcal))"
QUERIES["a30_archetypes"] = lambda spark, sf_dir: choices.archetypes(_solutions(spark, sf_dir), "query", "alt")
_N = "({c} - min({c}) OVER w) / greatest({m}, max({c}) OVER w - min({c}) OVER w)"
ORACLES["a30_archetypes"] = _S + ", f AS (SELECT *, round(sqrt(" + " + ".join(f"pow({_N.format(c=c, m=m)}, 2)" for c, m in choices.LEAST_SPAN.items()) + "), 9) AS far FROM s WINDOW w AS (PARTITION BY query)) SELECT query, " + ", ".join(f"first(alt ORDER BY {c}, alt) AS best_{c}" for c in choices.LEAST_SPAN) + ", first(alt ORDER BY far, alt) AS knee, round(min(far), 4) AS knee_distance FROM f GROUP BY 1"


def _intervals(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.collect_list(F.col("l_quantity") * 31.5 - 20).alias("m"))
    return lines.select(F.col("l_suppkey").alias("k"), F.posexplode(choices.intervals(F.col("m"))).alias("place", "minutes"))


QUERIES["f09_intervals"] = _intervals
ORACLES["f09_intervals"] = "SELECT l_suppkey AS k, (rn - 1)::INT AS place, minutes FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY minutes) AS rn FROM (SELECT DISTINCT l_suppkey, round(l_quantity * 31.5e0 - 20, 3) AS minutes FROM lineitem WHERE l_quantity * 31.5e0 - 20 > 0 AND l_quantity * 31.5e0 - 20 <= 1440)) WHERE rn <= 12"


def _mask(spark, sf_dir):
    """Cells of the raster farther than 60 m from every vertex of the tracks lose their value."""
    cells = view(spark, sf_dir, "grid_nodes").select("node_id", "lon", "lat", "dem")
    places = view(spark, sf_dir, "tracks").select("lon", "lat").distinct()
    near = spatial.within(cells.select("node_id", "lon", "lat"), places, 60.0).select(F.col("node_id").alias("n")).distinct()
    return cells.join(near, cells["node_id"] == near["n"], "left").select("node_id", F.when(F.col("n").isNotNull(), F.col("dem")).otherwise(-9999.0).alias("value"))


QUERIES["j29_corridor_mask"] = _mask
ORACLES["j29_corridor_mask"] = f"{with_views('grid_nodes', 'tracks')} SELECT node_id, CASE WHEN EXISTS (SELECT 1 FROM tracks b WHERE abs(b.lat - a.lat) < 0.0006 AND {sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 60) THEN dem ELSE -9999e0 END AS value FROM grid_nodes a"


def _weights(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") - 5).cast("double").alias("slope"), (F.col("p_partkey") % 7 - 3).cast("double").alias("heat"), (F.col("p_partkey") % 4 - 2).cast("double").alias("green"))
    return parts.select("p_partkey", *choices.normalised_weights(["slope", "heat", "green"], {"slope": 0.5, "heat": 0.3, "green": 0.2})).select("p_partkey", *(F.round(c, 6).alias(c) for c in ("slope", "heat", "green")))


QUERIES["a35_weights"] = _weights
ORACLES["a35_weights"] = "WITH w AS (SELECT p_partkey, greatest(0e0, p_size - 5) AS a, greatest(0e0, p_partkey % 7 - 3) AS b, greatest(0e0, p_partkey % 4 - 2) AS c FROM part) SELECT p_partkey, round(CASE WHEN a + b + c > 0 THEN a / (a + b + c) ELSE 0.5e0 END, 6) AS slope, round(CASE WHEN a + b + c > 0 THEN b / (a + b + c) ELSE 0.3e0 END, 6) AS heat, round(CASE WHEN a + b + c > 0 THEN c / (a + b + c) ELSE 0.2e0 END, 6) AS green FROM w"


def _od_table(spark, sf_dir):
    zones, facilities = view(spark, sf_dir, "zones"), view(spark, sf_dir, "facilities").select("facility_id", "lon", "lat")
    zones = zones.select(F.struct(F.col("zone_id").alias("origin"), sinks.od_text("climb_m", F.col("zone_id") / 2)).alias("zone"), "lon", "lat")
    near = spatial.place_pairs(zones, facilities.withColumnRenamed("facility_id", "destination"), "zone", "destination", 1000.0)
    texts = near.select("zone", "destination", sinks.od_text("distance_km", F.floor("distance_m") / 1000), sinks.od_text("minutes", F.floor("distance_m") / 61.3))
    return spatial.spread(texts, "zone", "destination").select("zone.origin", "destination", "distance_km", "minutes", "zone.climb_m")


QUERIES["w09_od_table"] = _od_table
ORACLES["w09_od_table"] = f"{with_views('zones', 'facilities')}, d AS (SELECT zone_id, facility_id, {sql_haversine('z.lon', 'z.lat', 'f.lon', 'f.lat')} AS d FROM zones z, facilities f) SELECT zone_id AS origin, facility_id AS destination, printf('%.3f', floor(d) / 1000) AS distance_km, printf('%.2f', floor(d) / 61.3e0) AS minutes, printf('%.1f', zone_id / 2) AS climb_m FROM d WHERE d <= 1000"


def _elevation(spark, sf_dir):
    """Heights looked up by the five-decimal key of a place; null where the cache has none."""
    cache = view(spark, sf_dir, "grid_nodes").select(node_cell("lon").alias("kx"), node_cell("lat").alias("ky"), "z")
    points = view(spark, sf_dir, "routes").select("route_id", "seq", F.round(F.col("lon") * 2000) / 2000, F.round(F.col("lat") * 2000) / 2000).toDF("route_id", "seq", "lon", "lat")
    return points.withColumns({"kx": node_cell("lon"), "ky": node_cell("lat")}).join(cache, ["kx", "ky"], "left").select("route_id", "seq", "z")


QUERIES["s15_elevation_lookup"] = _elevation
ORACLES["s15_elevation_lookup"] = f"{with_views('grid_nodes', 'routes')}, c AS (SELECT floor(lon * 100000 + 0.5e0)::BIGINT AS kx, floor(lat * 100000 + 0.5e0)::BIGINT AS ky, z FROM grid_nodes) SELECT route_id, seq, c.z FROM (SELECT route_id, seq, floor(round(lon * 2000) / 2000 * 100000 + 0.5e0)::BIGINT AS kx, floor(round(lat * 2000) / 2000 * 100000 + 0.5e0)::BIGINT AS ky FROM routes) p LEFT JOIN c USING (kx, ky)"
QUERIES["k25_tick_step"] = lambda spark, sf_dir: view(spark, sf_dir, "samples").select("k", "n", F.round(choices.tick_step(F.col("z2") + 0.37), 9).alias("step"))
ORACLES["k25_tick_step"] = with_views("samples") + " SELECT k, n, round(p * CASE WHEN r / p <= 1 THEN 1e0 WHEN r / p <= 2 THEN 2e0 WHEN r / p <= 5 THEN 5e0 ELSE 10e0 END, 9) AS step FROM (SELECT k, n, r, pow(10e0, floor(log10(r))) AS p FROM (SELECT k, n, (z2 + 0.37e0) / 5 AS r FROM samples))"
