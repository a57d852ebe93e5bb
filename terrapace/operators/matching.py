"""Tracks matched to streets by joins alone: candidates by cells, network distances by one shared frontier, the likeliest sequence by ordered folds.

Scores are whole numbers of millimetres' worth, so their sums don't depend on the order in which blocks are composed, and ties are real ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE_LAT, haversine_2d
from .chains import scan
from .network import stored
from .running import running_totals
from .search import shortest_paths
from .spatial import cell_at, cells_near, nearest_anywhere

# Fixed values of the model: error of a position and of distances along the network, in metres; and candidates of a point.
SIGMA, BETA, CANDIDATES = 4.07, 3.0, 10
#: The model's terms, residual^2 / (2 SIGMA^2) and difference / BETA, in millimetres and times 1e6 * 30 * SIGMA^2: 15 * mm^2 and 165,649 * mm, both whole.
PER_SQUARE_MM, PER_MM = 15, round(10_000 * SIGMA * SIGMA)
#: Stands for impossible; two of them can be added.
NEVER = -(1 << 60)
#: The ends of two candidates' streets.
STREETS = ["a_u", "a_v", "b_u", "b_v"]


def _mm(metres: str | Column) -> Column:
    return F.round((F.col(metres) if isinstance(metres, str) else metres) * 1000).cast("long")


def edge_candidates(points: DataFrame, segments: DataFrame, radius_m: float = 35.0) -> DataFrame:
    """The nearest CANDIDATES segments(u, v, lon1, lat1, lon2, lat2) within radius_m of each of points(track_id, seq, lon, lat).

    Columns track_id, seq, plon, plat, u, v, lon, lat (the foot point), residual_m, share (of the segment), length_m, place (from 1, by
    residual in millimetres, then u, v) and, where segments have z1 and z2, the foot point's z.
    """
    ends = (F.least("lon1", "lon2"), F.greatest("lon1", "lon2"), F.least("lat1", "lat2"), F.greatest("lat1", "lat2"))
    heights = ["z1", "z2"] if "z1" in segments.columns else []
    placed = stored(points.select("track_id", "seq", F.col("lon").alias("plon"), F.col("lat").alias("plat")).withColumn("cell", cell_at("plon", "plat", 2 * radius_m)), "placed")
    offered = segments.select("u", "v", "lon1", "lat1", "lon2", "lat2", *heights).withColumn("cell", F.explode(cells_near(*ends, radius_m, 2 * radius_m)))
    offered = offered.join(stored(placed.select("cell").distinct(), "cells"), "cell", "left_semi")
    reach = F.lit(radius_m / METRES_PER_DEGREE_LAT * 1.000001 + 1e-9)
    highest = F.greatest(F.abs(ends[2] - reach), F.abs(ends[3] + reach))
    wide = F.when(highest < 90.0, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(reach)) / F.cos(F.radians(highest)))))).otherwise(360.0)
    k = F.cos(F.radians((F.col("lat1") + F.col("lat2")) / 2))
    offered = offered.withColumns({"k": k, "length_m": haversine_2d("lon1", "lat1", "lon2", "lat2"), "middle": (ends[0] + ends[1]) / 2, "wide": (ends[1] - ends[0]) / 2 + wide, "low": ends[2] - reach, "high": ends[3] + reach})
    offered = stored(offered.withColumns({"ex": (F.col("lon2") - F.col("lon1")) * F.col("k"), "ey": F.col("lat2") - F.col("lat1")}), "offered")  # only where points are
    spark = points.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    off = F.abs(F.col("plon") - F.col("middle"))
    near = placed.repartition(tasks, "track_id", "seq").join(offered, "cell").where(F.col("plat").between(F.col("low"), F.col("high")) & (F.least(off, 360.0 - off) <= F.col("wide")))
    square = F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")
    share = F.when(square >= 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("plon") - F.col("lon1")) * F.col("k") * F.col("ex") + (F.col("plat") - F.col("lat1")) * F.col("ey")) / square))).otherwise(0.0)
    near = near.withColumn("share", share)
    near = near.withColumns({"lon": F.col("lon1") + F.col("share") * (F.col("lon2") - F.col("lon1")), "lat": F.col("lat1") + F.col("share") * (F.col("lat2") - F.col("lat1"))})
    near = near.withColumn("residual_m", haversine_2d("plon", "plat", "lon", "lat"))
    # What is too far is numbered last and left out after: a filter before would compute every foot point several times.
    place = F.row_number().over(Window.partitionBy("track_id", "seq").orderBy(F.col("residual_m") > radius_m, _mm("residual_m"), "u", "v"))
    z = [(F.col("z1") + F.col("share") * (F.col("z2") - F.col("z1"))).alias("z")] if heights else []
    return near.withColumn("place", place).where((F.col("place") <= CANDIDATES) & (F.col("residual_m") <= radius_m)).select("track_id", "seq", "plon", "plat", "u", "v", "lon", "lat", "residual_m", "share", "length_m", "place", *z)


def numbered(points: DataFrame) -> DataFrame:
    """points(track_id, seq, lon, lat) that have a place, with n from 0 in the order of seq, for tracks of two points or more; seq is unique in a track."""
    known = points.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) <= {most}" for c, most in (("lon", 180), ("lat", 90))))
    counted = stored(running_totals(known, ["track_id", "seq"], {"n": "1L"}), "points")
    ends = counted.groupBy("track_id").agg(F.min("n").alias("first"), F.count("*").alias("points")).where("points > 1")
    return counted.join(ends, "track_id").withColumn("n", F.col("n") - F.col("first")).drop("first", "points")


def _candidates(points: DataFrame, segments: DataFrame, nodes: DataFrame, radius_m: float) -> DataFrame:
    """edge_candidates() of points(track_id, seq, n, lon, lat), with n; a point without one has the nearest of nodes(node, lon, lat[, z])."""
    found = stored(edge_candidates(points, segments, radius_m), "candidates")
    bare = points.join(found.select("track_id", "seq"), ["track_id", "seq"], "left_anti").select("track_id", "seq", "lon", "lat")
    near = nearest_anywhere(bare, nodes.select("node", "lon", "lat"), "node", radius_m)
    near = near.withColumnsRenamed({"lon": "plon", "lat": "plat"}).join(nodes, "node").select("track_id", "seq", "plon", "plat", F.col("node").alias("u"), F.col("node").alias("v"), "lon", "lat", F.col("distance_m").alias("residual_m"), F.lit(0.0).alias("share"), F.lit(1.0).alias("length_m"), F.lit(1).alias("place"), *(["z"] if "z" in found.columns else []))
    return found.unionByName(near).join(points.select("track_id", "seq", "n"), ["track_id", "seq"])


def hop_metres(candidates: DataFrame, edges: DataFrame, radius_m: float) -> DataFrame:
    """(track_id, n, i, j, straight, along): metres from candidate i of point n - 1 to candidate j of point n, in a straight line between the points and along edges(u, v, cost), taken both ways.

    Ways longer than 3 x straight + 4 x radius_m aren't searched: that bound plus the distance of the two places stands for them. The
    search starts once from each node, as far as the farthest of all candidates around it asks, so tracks along one street share it.
    """
    side = lambda s, n: candidates.select("track_id", (F.col("n") + n).alias("n"), *(F.col(c).alias(f"{s}_{c}") for c in ("place", "plon", "plat", "u", "v", "lon", "lat", "share", "length_m")))
    straight = haversine_2d("a_plon", "a_plat", "b_plon", "b_plat")
    hops = side("a", 1).join(side("b", 0), ["track_id", "n"]).withColumn("straight", straight).withColumn("bound", 3 * F.col("straight") + 4 * radius_m)
    same = F.sort_array(F.array("a_u", "a_v")) == F.sort_array(F.array("b_u", "b_v"))
    ahead = F.abs(F.col("b_share") - F.when(F.col("a_u") == F.col("b_u"), F.col("a_share")).otherwise(1 - F.col("a_share"))) * F.col("b_length_m")
    part = lambda s, end: (F.col(f"{s}_share") if end == "u" else 1 - F.col(f"{s}_share")) * F.col(f"{s}_length_m")
    parts = [part(s, end).alias(f"{name}_{end}") for s, name in (("a", "out"), ("b", "into")) for end in "uv"]
    hops = hops.withColumn("same", F.when(same, ahead)).select("track_id", "n", F.col("a_place").alias("i"), F.col("b_place").alias("j"), "straight", "bound", "same", haversine_2d("a_lon", "a_lat", "b_lon", "b_lat").alias("apart"), *STREETS, *parts)
    hops = stored(hops, "hops")
    apart = hops.where("same is null")
    asked = apart.select("bound", F.inline(F.array(*(F.struct(F.col(f"a_{x}").alias("origin"), F.col(f"out_{x}").alias("out")) for x in "uv"))))
    starts = asked.groupBy("origin").agg(F.max(F.col("bound") - F.col("out")).alias("most")).where("most >= 0")
    both = edges.select("u", "v", "cost").union(edges.select("v", "u", "cost"))
    reach = stored(shortest_paths(both, stored(starts, "starts")).select("origin", "node", "cost"), "reach")
    # Ways are looked up once for each pair of streets, not for each pair of candidates.
    streets = apart.select(*STREETS).distinct()
    for x in "uv":
        for y in "uv":
            streets = streets.join(reach.select(F.col("origin").alias(f"a_{x}"), F.col("node").alias(f"b_{y}"), F.col("cost").alias(f"way_{x}{y}")), [f"a_{x}", f"b_{y}"], "left")
    until = lambda x, y: F.col(f"out_{x}") + F.col(f"way_{x}{y}")
    along = F.least(*(F.when(until(x, y) <= F.col("bound"), until(x, y) + F.col(f"into_{y}")) for x in "uv" for y in "uv"))
    found = hops.join(stored(streets, "streets"), STREETS, "left")
    return found.select("track_id", "n", "i", "j", "straight", F.coalesce("same", along, F.col("bound") + F.col("apart")).alias("along"))


def _sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _from_best(scores: Column) -> Column:
    """Scores less the best of them, so that they stay small on tracks of any length."""
    return F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.greatest(x - F.array_max(s), F.lit(NEVER))))[0]


def _step(state: Column, f: Column) -> Column:
    return _from_best(F.transform(f, lambda row: F.array_max(_sum(state, row))))


def _both(f: Column, g: Column) -> Column:
    """Best scores over two steps: a product of matrices in which sums are products and maxima are sums."""
    none = F.array_repeat(F.lit(NEVER).cast("long"), CANDIDATES)
    least = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y))
    return F.transform(g, lambda row: F.aggregate(F.zip_with(row, f, lambda w, before: F.transform(before, lambda x: x + w)), none, least))


def decode(hops: DataFrame, candidates: DataFrame) -> DataFrame:
    """(track_id, n, place): the likeliest candidate of each point; of equal ones the first, judged from the end of the track."""
    emit = candidates.select("track_id", "n", F.col("place").alias("j"), F.when((F.col("u") != F.col("v")), -PER_SQUARE_MM * _mm("residual_m") * _mm("residual_m")).otherwise(0).alias("emit"))  # a nearest node is alone
    moves = hops.select("track_id", "n", "i", "j", (-PER_MM * F.abs(_mm("straight") - _mm("along"))).alias("move"))
    starts = emit.where("n = 0").select("track_id", "n", F.lit(1).alias("i"), "j", F.lit(0).cast("long").alias("move"))
    scored = moves.union(starts).join(emit, ["track_id", "n", "j"]).withColumn("score", F.col("move") + F.col("emit"))
    rows = scored.groupBy("track_id", "n", "j").agg(F.array(*(F.coalesce(F.max(F.when(F.col("i") == i, F.col("score"))), F.lit(NEVER)) for i in range(1, CANDIDATES + 1))).alias("row"))
    never = F.array_repeat(F.lit(NEVER).cast("long"), CANDIDATES)
    f = F.array(*(F.coalesce(F.max(F.when(F.col("j") == j, F.col("row"))), never) for j in range(1, CANDIDATES + 1)))
    steps = stored(rows.groupBy(F.col("track_id").alias("key"), F.col("n").alias("at")).agg(f.alias("f")), "steps")
    first = steps.select("key").distinct().withColumn("state", F.array(F.lit(0).cast("long"), *[F.lit(NEVER).cast("long")] * (CANDIDATES - 1)))
    states = stored(scan(steps, first, _step, _both), "scores")
    best = lambda scores: F.array_position(scores, F.array_max(scores)).cast("int")
    last = states.groupBy("key").agg(F.max("at").alias("last"), F.max_by("state", "at").alias("state")).withColumn("place", best(F.col("state")))
    before = steps.join(states.select("key", (F.col("at") + 1).alias("at"), "state"), ["key", "at"]).join(last.select("key", "last"), "key")
    back = before.select("key", (F.col("last") - F.col("at")).alias("at"), F.transform("f", lambda row: best(_sum(F.col("state"), row))).alias("f"))
    ways = scan(back, last.select("key", F.col("place").alias("state")), lambda place, f: F.element_at(f, place), lambda f, g: F.transform(f, lambda place: F.element_at(g, place)))
    found = ways.join(last.select("key", "last"), "key").select("key", (F.col("last") - F.col("at") - 1).alias("n"), F.col("state").alias("place"))
    return found.union(last.select("key", F.col("last").alias("n"), "place")).withColumnRenamed("key", "track_id")


def match_tracks(points: DataFrame, segments: DataFrame, nodes: DataFrame | None = None, radius_m: float = 35.0) -> DataFrame:
    """(track_id, seq, n, u, v, lon, lat, residual_m[, z]): points(track_id, seq, lon, lat) on the streets they most likely followed.

    segments(u, v, lon1, lat1, lon2, lat2[, z1, z2]) are taken both ways; nodes(node, lon, lat[, z]). Points without a street within radius_m take
    the nearest node (u = v). Points without a place, and tracks of fewer than two points, are left out; z is read off the streets.
    Without nodes, points are candidates as edge_candidates() gives them, and segments the edges(u, v, cost) that ways follow.
    """
    if nodes is None:
        places = numbered(points.select("track_id", "seq", F.col("plon").alias("lon"), F.col("plat").alias("lat")).distinct())
        candidates = stored(points.join(places.select("track_id", "seq", "n"), ["track_id", "seq"]), "candidates")
        return _chosen(candidates, segments, radius_m)
    points = stored(numbered(points.select("track_id", "seq", "lon", "lat")), "points")
    candidates = stored(_candidates(points, segments, nodes, radius_m), "candidates")
    edges = segments.select("u", "v", haversine_2d("lon1", "lat1", "lon2", "lat2").alias("cost"))
    return _chosen(candidates, edges, radius_m)


def _chosen(candidates: DataFrame, edges: DataFrame, radius_m: float) -> DataFrame:
    chosen = decode(hop_metres(candidates, edges, radius_m), candidates)
    return candidates.join(chosen, ["track_id", "n", "place"]).select("track_id", "seq", "n", "u", "v", "lon", "lat", "residual_m", *(["z"] if "z" in candidates.columns else []))


def match_summary(matched: DataFrame) -> DataFrame:
    """Points, mean residual, matched metres and, where there are heights, climb of each track of match_tracks()."""
    heights = "z" in matched.columns
    before = matched.select("track_id", (F.col("n") + 1).alias("n"), F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), *([F.col("z").alias("z0")] if heights else []))
    gain = [F.sum(F.greatest(F.lit(0.0), F.col("z") - F.col("z0"))).alias("gain_m")] if heights else []
    both = matched.join(before, ["track_id", "n"], "left").withColumn("hop", haversine_2d("lon0", "lat0", "lon", "lat"))
    return both.groupBy("track_id").agg(F.count("*").alias("points"), F.avg("residual_m").alias("mean_error_m"), F.sum("hop").alias("metres"), *gain)
