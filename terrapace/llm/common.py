"""Shared pieces of the corpus operators: keys, shared storage, words, hashes and components."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import shutil
import sys
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "__key"
#: Java's form of the contract's white space class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


# -- shared storage -----------------------------------------------------------


_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor see: ``spark.checkpoint.dir``; a temporary one only in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _own_dir.get("path")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir["path"] = tempfile.mkdtemp(prefix="terrapace-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files behind a frame made by stored()."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(name)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of one batch that Spark hands to a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that Python workers get by bytes, however long the texts are; Spark's default bound is for shorter rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


# -- keys ---------------------------------------------------------------------


class Keyed:
    """A frame with a unique, non-null long KEY that follows the order of its id.

    Ids that are unique and not null are their own keys and cost one look at the id column.
    Otherwise rows are numbered in the order (id with null first, then the given columns) and
    stored; repeated rows stay separate rows. ``restore`` turns keys in a result into ids.
    """

    def __init__(self, df: DataFrame, id_col: str, columns: list[str], then: list[str]):
        small_batches(df.sparkSession)
        df = df.select(F.col(id_col).cast("long").alias(KEY), *columns)
        odd = df.groupBy(KEY).count().where(F.col(KEY).isNull() | (F.col("count") > 1))
        self.plain = not odd.take(1)
        self.df = df
        if not self.plain:
            # Equal rows may be cut anywhere, so a large group of them is not one task's.
            salted = df.withColumnRenamed(KEY, "__id").withColumn("__salt", F.rand(5))
            ordered = salted.repartitionByRange("__id", *then, "__salt").sortWithinPartitions("__id", *then).drop("__salt")
            self.df = stored(ordered.withColumn(KEY, F.monotonically_increasing_id()), "keyed")
            self.ids = self.df.select(KEY, "__id")

    def restore(self, result: DataFrame, names: dict[str, str]) -> DataFrame:
        """names: a column that holds keys to the id column that takes its place."""
        if self.plain:
            return result.withColumnsRenamed(names)
        for col, name in names.items():
            ids = self.ids.select(F.col(KEY).alias(col), F.col("__id").alias(name))
            result = result.join(ids, col, "left").drop(col)
        return result


def partitions(df: DataFrame, at_least: int = 1) -> int:
    """The session's shuffle partitions."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


# -- words and rolling hashes, over many documents at once ---------------------

U = np.uint64
_rng = np.random.default_rng(20240607)
#: A random odd-free 64-bit value for each byte, and an odd base for the polynomial.
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    out = np.ones(max(n, 1), dtype=U)
    if n > 1:
        done = 1
        while done < n:
            step = min(done, n - done)
            np.multiply(out[:step], U(pow(base, done, 2**64)), out=out[done : done + step])
            done += step
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the whole word."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers = {b: np.ones(1, dtype=U) for b in (BASE, INVERSE)}


def _first_powers(base: int, n: int) -> np.ndarray:
    """As powers(), kept between calls while n stays moderate."""
    if len(_powers[base]) < n:
        found = powers(base, n)
        if n > 8 << 20:
            return found
        _powers[base] = found
    return _powers[base][:n]


class Prefix:
    """Prefix polynomial hashes over a sequence of 64-bit values: the hash of any slice in O(1)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.at = np.zeros(n + 1, dtype=U)
        np.cumsum(values * _first_powers(BASE, n)[:n], out=self.at[1:])
        self.back = _first_powers(INVERSE, n + 1)

    def slices(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.at[stop] - self.at[start]) * self.back[start]

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all windows of k values."""
        n = len(self.at) - k
        return (self.at[k:] - self.at[:n]) * self.back[:n] if n > 0 else np.zeros(0, dtype=U)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by doubling."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < w:
        x = np.minimum(x[: len(x) - (w - size)], x[w - size :])
    return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Words of more bytes are hashed one by one.
LONG_WORD = 128
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)


def digests(data: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64 bits of the BLAKE2 digest of each slice, as int64."""
    view = memoryview(data)
    return np.frombuffer(b"".join([hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), stop.tolist())]), dtype="<i8")


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each word, mixed in eight bytes at a time.

    A polynomial modulo 2**64 would give some long words of a regular build (Thue-Morse) one hash, whatever its base.
    """
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = stop - start
    out = mix(size.astype(U) * U(BASE) + U(INVERSE))
    at, live = 0, np.flatnonzero(size <= LONG_WORD)
    while len(live):
        out[live] = mix(out[live] ^ (eight[start[live] + at] & _LOW_BYTES[np.minimum(size[live] - at, 8)]))
        at += 8
        live = live[size[live] > at]
    long = np.flatnonzero(size > LONG_WORD)
    out[long] = digests(data.tobytes() if len(long) else b"", start[long], stop[long]).view(U)
    return out


class Words:
    """The words of many texts: byte offsets and hashes, and each text's range of words."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data = data
        space = _SPACE[data]
        before = np.concatenate(([True], space[:-1]))
        self.start = np.flatnonzero(before & ~space)
        self.stop = np.flatnonzero(space & ~before)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.text_start = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        self.first = np.searchsorted(self.start, self.text_start)
        self.last = np.concatenate((self.first[1:], [len(self.start)]))
        self.hash = word_hashes(data, self.start, self.stop)

    def packed(self) -> tuple[bytes, np.ndarray]:
        """The words with one space after each, and where each begins; the end of the last one comes last."""
        keep = ~_SPACE[self.data]
        keep[self.stop] = True
        data = self.data[keep]
        return np.where(_SPACE[data], np.uint8(32), data).tobytes(), np.concatenate(([0], np.cumsum(self.stop - self.start + 1)))


def batches(frames, column: str, most: int = 24 << 20):
    """Regroups pandas batches so that each holds about `most` characters of text; nothing larger is ever held, but for one text."""
    held, size = [], 0
    for frame in frames:
        if not len(frame):
            continue
        lengths = frame[column].str.len().fillna(0).to_numpy()
        cut, run = 0, 0
        for i, n in enumerate(lengths):
            run += int(n)
            if size + run >= most:
                held.append(frame.iloc[cut : i + 1])
                yield held
                held, size, cut, run = [], 0, i + 1, 0
        if cut < len(frame):
            held.append(frame.iloc[cut:])
            size += run
    if held:
        yield held


def encoded(texts) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def give_back() -> None:
    """Hands memory that this worker has freed back to the system, where the platform can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def tidied(run):
    """run for mapInPandas, after which the worker, that Spark keeps for later stages, hands back what the task took."""

    def whole(frames):
        yield from run(frames)
        give_back()

    return whole


# -- connected components -----------------------------------------------------


#: A node with this many edges, or with more than the MOST_HEAVY-th part of all edges' ends, is heavy.
HEAVY_EDGES = 512
MOST_HEAVY = 50_000


def _met_least(edges: DataFrame, heavy_from: int | None) -> DataFrame:
    """edges(a, b) with m, the least b of their a.

    Edges of heavy nodes take it from a broadcast table, which has at most MOST_HEAVY rows as a heavy node holds at
    least that part of all ends; so the shuffle of the others by `a` has no large key.
    """
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d"))
    if heavy_from is None:
        return edges.join(low.drop("d"), "a")
    heavy = F.broadcast(low.where(F.col("d") >= heavy_from).drop("d"))
    light = low.where(F.col("d") < heavy_from).drop("d")
    return edges.join(heavy, "a").union(edges.join(heavy.select("a"), "a", "left_anti").join(light, "a"))


def join_heavy(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows joined with table, which is stored and has a row for each key with the number of rows (`weight`, left out) that it meets, so that no key is large in a shuffle, see _met_least()."""
    total, most = table.agg(F.sum(weight), F.max(weight)).first()
    heavy_from = max(HEAVY_EDGES, (total or 0) // MOST_HEAVY)
    if (most or 0) < heavy_from:
        return rows.join(table.drop(weight), key)
    heavy = F.broadcast(table.where(F.col(weight) >= heavy_from).drop(weight))
    light = table.where(F.col(weight) < heavy_from).drop(weight)
    return rows.join(heavy, key).union(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable.

    Alternating large-star and small-star steps; each is one aggregation by node (combined
    map-side) and one equi-join, in which the least neighbours of heavy nodes are broadcast, so a hub costs no single task.
    The edge list is stored after each round. Nodes without edges are not returned.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(now, "edges")
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends, most = both.groupBy("a").count().agg(F.sum("count"), F.max("count")).first()
        if not ends:
            break
        heavy_from = max(HEAVY_EDGES, ends // MOST_HEAVY)
        low = _met_least(both, heavy_from if most >= heavy_from else None).withColumn("m", F.least("m", "a"))
        large = low.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = hung.union(low.select("a", F.col("m").alias("b"))).distinct()
        after = stored(small, "edges")
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum((F.col("a") % 1000003) * (F.col("b") % 999983))).first()
        drop_stored(now)
        now = after
        if before == sums:
            break
        before = sums
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, columns)


def long_schema(**fields: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in fields.items()))
