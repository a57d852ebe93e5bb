"""Street networks: directed edges, degrees, components and heights filled from neighbours."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine_2d, node_cell

DEM_MIN_RUN_M = 10.0
VERTEX_MIN_RUN_M = 1.0


_own_dir: dict[str, str] = {}


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir, deleted when the session's JVM ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own_dir.get("path")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_dir["path"] = tempfile.mkdtemp(prefix="terrapace-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that loops keep no lineage."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files behind a frame made by stored()."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)


def nodes(segments: DataFrame) -> DataFrame:
    """Distinct ends of segments(lon1, lat1, z1, lon2, lat2, z2) at five decimals: nx, ny, lon, lat, z (null where 0: no height)."""
    ends = segments.select(F.col("lon1").alias("lon"), F.col("lat1").alias("lat"), F.col("z1").alias("z")).union(segments.select("lon2", "lat2", "z2"))
    ends = ends.select(node_cell("lon").alias("nx"), node_cell("lat").alias("ny"), "lon", "lat", F.nullif("z", F.lit(0.0)).alias("z"))
    return ends.groupBy("nx", "ny").agg(F.min(F.struct(F.col("z").isNull(), "z", "lon", "lat")).alias("e")).select("nx", "ny", "e.lon", "e.lat", "e.z")


def directed_edges(segments: DataFrame, measured: bool = True, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Both directions of segments(u, v, lon1 .. z2, oneway, attributes), without loops; of parallel repeats the shortest stays.

    Columns u, v, length_m, slope_pct, against_oneway, reverse_of_two_way and the attributes. Slopes are over
    1 m at least where heights are the network's own (measured), else over 10 m; 0 for 0.1 m and less.
    """
    d = haversine_2d("lon1", "lat1", "lon2", "lat2")
    slope = F.when(d > 0.1, 100.0 * (F.col("z2") - F.col("z1")) / F.greatest(d, F.lit(VERTEX_MIN_RUN_M if measured else DEM_MIN_RUN_M))).otherwise(0.0)
    measures = F.struct(F.greatest(F.lit(0.1), d).alias("length_m"), slope.alias("slope_pct"))
    base = segments.where("u <> v").groupBy("u", "v", "oneway", *attributes).agg(F.min(measures).alias("m"))
    # Both directions come from one row, so segments are read, and parallel ones settled, once.
    ahead = F.struct("u", "v", F.col("m.slope_pct").alias("slope_pct"), F.lit(False).alias("against_oneway"), F.lit(False).alias("reverse_of_two_way"))
    back = F.struct(F.col("v").alias("u"), F.col("u").alias("v"), (-F.col("m.slope_pct")).alias("slope_pct"), F.col("oneway").alias("against_oneway"), (~F.col("oneway")).alias("reverse_of_two_way"))
    both = base.select(F.explode(F.array(ahead, back)).alias("e"), F.col("m.length_m").alias("length_m"), "oneway", *attributes)
    return both.select("e.u", "e.v", "length_m", "e.slope_pct", "e.against_oneway", "e.reverse_of_two_way", "oneway", *attributes)


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node, whatever the direction."""
    both = edges.select("u", "v").union(edges.select("v", "u")).distinct()
    return both.groupBy("u").agg(F.count("*").alias("degree"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable, direction aside.

    Large-star and small-star steps over a stored edge list; a logarithmic number of rounds in practice.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "components")
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        after = stored(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct(), "components")
        sums = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        drop_stored(now)
        now = after
        if sums == before:
            break
        before = sums
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def fill_heights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(node, z) with missing heights filled ring by ring: the mean of the neighbours that are known, parallel edges counting each; 0 where none can be reached."""
    from .fixpoint import Rounds

    links = stored(edges.select("u", "v").union(edges.select("v", "u")), "links")
    nodes = nodes.select("node", F.col("z").cast("double"))
    known = Rounds(nodes.where("z is not null"), "heights")
    front = known.last()
    while front.take(1):  # each ring looks only beside what the last one filled, and stores only what it fills
        beside = links.join(front.select(F.col("node").alias("v")), "v").select("u").distinct()
        beside = beside.join(known.all().select(F.col("node").alias("u")), "u", "left_anti").join(nodes.select(F.col("node").alias("u")), "u", "left_semi")
        ring = links.join(beside, "u").join(known.all().select(F.col("node").alias("v"), "z"), "v").groupBy("u").agg(F.avg("z").alias("z"))
        front = known.add(ring.withColumnRenamed("u", "node"))
    return nodes.select("node").join(known.all().select("node", "z"), "node", "left").select("node", F.coalesce("z", F.lit(0.0)).alias("z"))


def compatible_snap(pairs: DataFrame, nodes: DataFrame, radius_m: float) -> DataFrame:
    """(pair_id, node_o, node_d, shared): the ends of pairs(pair_id, lon_o, lat_o, lon_d, lat_d) snapped into one component.

    nodes(node, lon, lat, component). Of the components within reach of both ends the one of the least total distance wins, then the
    larger one; where none is shared, each end takes its nearest node. Ends beyond radius_m of every node stay null.
    """
    from .spatial import within

    sizes = nodes.groupBy("component").agg(F.count("*").alias("size"))

    def near(end: str) -> DataFrame:
        places = pairs.select("pair_id", F.col(f"lon_{end}").alias("lon"), F.col(f"lat_{end}").alias("lat"))
        found = within(places, nodes.select("node", "lon", "lat", "component"), radius_m, distance="d")
        return found.groupBy("pair_id", "component").agg(F.min(F.struct("d", "node")).alias(end))

    both = near("o").join(near("d"), ["pair_id", "component"], "full").join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, "component")
    total = F.when(F.col("o").isNotNull() & F.col("d").isNotNull(), F.struct((F.col("o.d") + F.col("d.d")).alias("total"), (-F.col("size")).alias("less"), F.col("o.node").alias("o"), F.col("d.node").alias("d")))
    best = both.groupBy("pair_id").agg(F.min(total).alias("both"), F.min("o").alias("o"), F.min("d").alias("d"))
    found = best.select("pair_id", F.coalesce("both.o", "o.node").alias("node_o"), F.coalesce("both.d", "d.node").alias("node_d"), F.col("both").isNotNull().alias("shared"))
    return pairs.select("pair_id").join(found, "pair_id", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


def reached_pieces(times: DataFrame, edges: DataFrame, cutoff_s: float) -> DataFrame:
    """(origin, u, v, fraction): how far streets can be gone within cutoff_s, from times(origin, node, cost) and edges(u, v, cost), both in seconds.

    Of parallel edges the farthest counts; a street gone wholly from both ends is there once, from its smaller node.
    """
    started = times.where(F.col("cost") <= cutoff_s).select("origin", F.col("node").alias("u"), F.col("cost").alias("t"))
    fraction = F.least(F.lit(1.0), (cutoff_s - F.col("t")) / F.col("cost"))
    pieces = started.join(edges.where("cost is not null").groupBy("u", "v").agg(F.min("cost").alias("cost")), "u").select("origin", "u", "v", fraction.alias("fraction")).where("fraction > 0")
    # Both ways of a street come together under its ends in order; so no self-join.
    street = pieces.withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")}).groupBy("origin", "a", "b")
    ways = street.agg(F.max(F.when(F.col("u") < F.col("v"), F.col("fraction"))).alias("ahead"), F.max(F.when(F.col("u") > F.col("v"), F.col("fraction"))).alias("back"))
    drawn = F.array(F.when(F.col("ahead").isNotNull(), F.struct(F.col("a").alias("u"), F.col("b").alias("v"), F.col("ahead").alias("fraction"))), F.when(F.col("back").isNotNull() & ~((F.col("back") >= 1) & (F.coalesce("ahead", F.lit(0.0)) >= 1)), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), F.col("back").alias("fraction"))))
    return ways.select("origin", F.explode(F.filter(drawn, lambda x: x.isNotNull())).alias("p")).select("origin", "p.*")
