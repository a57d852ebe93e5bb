"""Embedding whitening by upper-triangle column aggregates.

One aggregation sums the centred products of every pair of dimensions, by generated SQL expressions; the covariance is put together from its
rows and decomposed by LAPACK. The triangle is cut into tiles, each a group of that aggregation with an expression for every pair in a tile: all 2,080 pairs of
64 dimensions in one row's aggregate make methods that the JVM doesn't compile, and thousands of dimensions would not be planned at all. Sums are of integers centred on the whole part of each mean; the means' fractions are taken
off exactly afterwards. So neither the order of rows nor the partitions change a digit, and nothing is lost where means are far above deviations.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: 64 * entry is held between +/- this, so that differences of two fit a long.
FARTHEST = float(1 << 61)
#: Dimensions of a tile's side: TILE * TILE sums in one group.
TILE = 8
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x: array of longs) of the rows whose vector is not null and holds finite entries only."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v"))
    sound = F.expr("v is not null and forall(v, e -> e is not null and not isnan(e) and abs(e) < double('Infinity'))")
    x = F.transform("v", lambda e: F.floor(F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), e * float(SCALE)))).cast("long") + F.lit(SHIFT).cast("long"))
    return rows.where(F.coalesce(sound, F.lit(False))).select("vec_id", x.alias("x"))


def product_sums(frame: DataFrame, column: str, dim: int) -> dict[tuple[int, int], int | float]:
    """{(i, j): sum of column[i] * column[j]} over all rows, for i <= j < dim: one aggregation, with a row for each tile and task in its shuffle."""
    side = -(-dim // TILE)
    tiles = [(a, b) for a in range(side) for b in range(a, side)]
    part = lambda k: F.slice(column, k * TILE + 1, TILE)
    blocks = frame.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), part(a).alias("x"), part(b).alias("y")) for a, b in tiles))))
    sums = blocks.groupBy("a", "b").agg(*(F.expr(f"sum(get(x, {i}) * get(y, {j})) as s{i}_{j}") for i in range(TILE) for j in range(TILE))).collect()
    spots = [(r["a"] * TILE + i, r["b"] * TILE + j, r[f"s{i}_{j}"]) for r in sums for i in range(TILE) for j in range(TILE)]
    return {(i, j): s for i, j, s in spots if i <= j < dim}


def moments(fit: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums per dimension, n * n * covariance), all exact, of fit(x), whose vectors have dim entries."""
    entries = fit.select(F.posexplode("x").alias("i", "e"))
    ends = entries.groupBy("i").agg(F.count("*"), F.sum(F.col("e").cast("decimal(20,0)")), F.min("e"), F.max("e")).orderBy("i").collect()  # a row for each dimension
    n, sums = ends[0][1], [int(r[2]) for r in ends]
    whole = [s // n for s in sums]
    rest = [s - n * w for s, w in zip(sums, whole)]
    far = max(max(r[4] - w, w - r[3]) for r, w in zip(ends, whole)) + 1
    # Exact unless a sum could pass 38 digits, which takes entries beyond any embedding's.
    kind = "bigint" if far * far * n < 1 << 62 else "decimal(19,0)" if far < 10**18 and far * far * n < 10**37 else "double"
    centred = fit.select(F.expr(f"zip_with(x, array({', '.join(f'{w}L' for w in whole)}), (e, m) -> cast(e - m as {kind}))").alias("d"))
    cov = [[0] * dim for _ in range(dim)]
    for (i, j), p in product_sums(centred, "d", dim).items():
        cov[i][j] = cov[j][i] = n * int(p) - rest[i] * rest[j]
    return n, sums, cov


def principal(n: int, cov: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors as columns, trace), the largest first; values that rounding can't tell from 0 are 0."""
    v = np.array([[float(Fraction(c, n * n)) for c in row] for row in cov])
    values, vectors = np.linalg.eigh(v)
    trace = float(Fraction(sum(cov[i][i] for i in range(len(cov))), n * n))
    order = np.argsort(-values, kind="stable")[:most]
    values = values[order]
    return np.where(values > trace * len(cov) * 1e-14, values, 0.0), vectors[:, order], trace


def _projected(frame: DataFrame, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """frame with deviation and w, the whitened values of its x by component (null for components without variance).

    deviation is the sum of (n * x - S)**2, exact: with S = n * m + r and d = x - m it is n*n * sum(d*d) - 2*n * sum(d*r) + sum(r*r). Null beyond 38 digits.
    """
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s - n * int(w) for s, w in zip(sums, whole)]
    fractions = np.array([float(Fraction(r, n)) for r in rest])
    basis = vectors / np.sqrt(np.where(values > 0, values, 1.0))
    flat, least = values <= 0, sum(r * r for r in rest)
    fields = [pa.field("deviation", pa.decimal128(38, 0)), pa.field("w", pa.list_(pa.float64()))]

    def run(batches):
        for batch in batches:
            d = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(whole)) - whole
            far = int(np.abs(d).max(initial=0)) + 1
            exact = d if far * max(far, n) * len(whole) < 1 << 62 else d.astype(object)
            squares, cross = (exact * exact).sum(axis=1).tolist(), (exact * np.array(rest, dtype=exact.dtype)).sum(axis=1).tolist()
            found = [n * n * a - 2 * n * b + least for a, b in zip(squares, cross)]
            deviation = pa.array([Decimal(x) if x < 10**38 else None for x in found], pa.decimal128(38, 0))
            w = (d - fractions) @ basis
            w = pa.array(w.ravel(), mask=np.broadcast_to(flat, w.shape).ravel())
            lists = pa.ListArray.from_arrays(np.arange(0, len(w) + 1, len(flat), dtype=np.int32), w)
            schema = pa.schema([*batch.schema, *fields])
            yield pa.RecordBatch.from_arrays([*batch.columns, deviation, lists], schema=schema)

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *T._parse_datatype_string("deviation decimal(38,0), w array<double>").fields]))


def _identity_error(w: DataFrame, varying: list[int], n: int) -> float:
    """The largest absolute entry of the covariance of w's varying components over the fit list, minus the identity."""
    if not varying:
        return 0.0
    w = w.select(F.array(*(F.col("w")[k] for k in varying)).alias("w"))
    means = w.select(F.posexplode("w").alias("i", "e")).groupBy("i").agg(F.avg("e")).orderBy("i").collect()
    w = w.select(F.zip_with("w", F.array(*(F.lit(float(m[1])) for m in means)), lambda e, m: e - m).alias("w"))
    return max(abs(s / n - (i == j)) for (i, j), s in product_sums(w, "w", len(varying)).items())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row per vector and component up to `most`: vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    Rows whose vector is null or has null or non-finite entries are dropped. An entry c becomes floor(64 * c) + 1000000
    (64 * c is held within +/- 2**61). The model is fitted on each distinct vector once and applied to every row, so repeated rows
    and rows with a null id have results of their own, equal for equal vectors. Vectors of unlike length are whitened apart; empty
    ones have no components, and so no rows. A component without variance (one distinct vector, constant dimensions, or
    more dimensions than distinct vectors) has whitened null and stays out of identity_error; explained is null where no dimension varies.
    deviation is null if it takes more than 38 digits. An empty table gives an empty result. Other columns are ignored.

    The fit list is stored once; sums per dimension, of products and of whitened products are one aggregation each, with rows for
    dimensions and tiles to the driver. Nothing else leaves the executors, but the distinct lengths.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vec_col)
    fit = stored(rows.select("x").distinct(), "fit-list")
    result = spark.createDataFrame([], RESULT)
    for dim in sorted(r[0] for r in fit.select(F.size("x")).distinct().collect() if r[0] > 0):
        own = fit.where(F.size("x") == dim)
        n, sums, cov = moments(own, dim)
        values, basis, trace = principal(n, cov, most)
        error = _identity_error(_projected(own, n, sums, values, basis), [k for k, e in enumerate(values) if e > 0], n)
        explained = F.array(*(F.lit(float(e / trace) if trace > 0 else None).cast("double") for e in values))
        one = _projected(rows.where(F.size("x") == dim), n, sums, values, basis).select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
        result = result.union(one.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(float(error)).alias("identity_error")))
    return result
