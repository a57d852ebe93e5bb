"""Rasters as tables of cells: sampling, cubic patches, weighted surfaces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(points: DataFrame, cells: DataFrame, origin: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """points(lon, lat) with the value columns of the cell(row, col) that they fall into; null outside."""
    at = points.withColumns({"col": F.floor((F.col("lon") - origin[0]) / step[0]).cast("long"), "row": F.floor((F.col("lat") - origin[1]) / step[1]).cast("long")})
    return at.join(cells, ["row", "col"], "left")


def cubic(t: Column) -> Column:
    """Keys weight with a = -1/2."""
    a = F.abs(t)
    return F.when(a <= 1, (1.5 * a - 2.5) * a * a + 1).when(a < 2, ((-0.5 * a + 2.5) * a - 4) * a + 2).otherwise(0.0)


def bicubic(points: DataFrame, cells: DataFrame, key: str, origin: tuple[float, float], step: tuple[float, float], value: str = "value") -> DataFrame:
    """(key, z, cells): cubic interpolation over the 4 x 4 cells around each point; missing cells count as 0."""
    x, y = (F.col("lon") - origin[0]) / step[0], (F.col("lat") - origin[1]) / step[1]
    at = points.select(key, x.alias("x"), y.alias("y"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1, 2) for j in (-1, 0, 1, 2)))).alias("o"))
    at = at.select(key, (F.floor("x") + F.col("o.i")).cast("long").alias("col"), (F.floor("y") + F.col("o.j")).cast("long").alias("row"), (cubic(F.col("x") - F.floor("x") - F.col("o.i")) * cubic(F.col("y") - F.floor("y") - F.col("o.j"))).alias("w"))
    return at.join(cells, ["row", "col"], "left").groupBy(key).agg(F.sum(F.col("w") * F.coalesce(F.col(value), F.lit(0.0))).alias("z"), F.count(value).alias("cells"))


def friction_surface(cells: DataFrame, weights: dict[str, float], inverted: tuple[str, ...] = ()) -> DataFrame:
    """cells with `friction`: the weighted mean of the criteria's min-max values that a cell has; null where it has none."""
    ends = cells.agg(*(f(c).alias(f"{c}_{n}") for c in weights for f, n in ((F.min, "low"), (F.max, "high"))))
    rows = cells.crossJoin(F.broadcast(ends))  # one row
    norm = {c: (F.col(c) - F.col(f"{c}_low")) / F.nullif(F.col(f"{c}_high") - F.col(f"{c}_low"), F.lit(0.0)) for c in weights}
    norm = {c: 1.0 - x if c in inverted else x for c, x in norm.items()}
    total = sum((F.coalesce(x * weights[c], F.lit(0.0)) for c, x in norm.items()), F.lit(0.0))
    covered = sum((F.when(x.isNotNull(), weights[c]).otherwise(0.0) for c, x in norm.items()), F.lit(0.0))
    return rows.withColumn("friction", F.when(covered > 0, total / covered)).drop(*ends.columns)


#: Random consistency index of pairwise matrices of size 1 to 10.
RANDOM_INDEX = (0.0, 0.0, 0.58, 0.90, 1.12, 1.24, 1.32, 1.41, 1.45, 1.49)


def ahp(matrix: DataFrame, key: str) -> DataFrame:
    """Priorities of pairwise matrices(key, i, j, value): key, i, weight, lambda_max, ci, cr, consistent. Matrices of more than ten rows take the tenth index."""
    columns = matrix.groupBy(key, "j").agg(F.sum("value").alias("s"))
    shares = matrix.join(columns, [key, "j"]).select(key, "i", (F.col("value") / F.col("s")).alias("x"))
    weights = shares.groupBy(key, "i").agg(F.avg("x").alias("weight"))
    product = matrix.join(weights.select(key, F.col("i").alias("j"), F.col("weight").alias("wj")), [key, "j"]).groupBy(key, "i").agg(F.sum(F.col("value") * F.col("wj")).alias("p"))
    top = product.join(weights, [key, "i"]).groupBy(key).agg(F.avg(F.col("p") / F.col("weight")).alias("lambda_max"), F.count("*").alias("m"))
    ci = F.when(F.col("m") > 1, (F.col("lambda_max") - F.col("m")) / (F.col("m") - 1)).otherwise(0.0)
    ri = F.element_at(F.array(*map(F.lit, RANDOM_INDEX)), F.least(F.col("m"), F.lit(10)).cast("int"))
    top = top.select(key, "lambda_max", "m", ci.alias("ci"), F.when(ri > 0, ci / ri).otherwise(0.0).alias("cr"))
    return weights.join(top, key).withColumn("consistent", (F.col("cr") <= 0.10) | (F.col("m") <= 2)).drop("m")


def local_area_ha(points: DataFrame, key: str) -> DataFrame:
    """Shoelace area of each ring of points(key, seq, lon, lat) in metres around its mean latitude."""
    w = __import__("pyspark").sql.Window.partitionBy(key)
    turn = w.orderBy("seq")
    k = F.cos(F.radians(F.avg("lat").over(w))) * 111320.0
    flat = points.select(key, "seq", (F.col("lon") * k).alias("x"), (F.col("lat") * 110574.0).alias("y"), F.first("lon").over(turn).alias("lon0"), F.first("lat").over(turn).alias("lat0"), k.alias("k"))
    closed = flat.select(key, "x", "y", F.coalesce(F.lead("x").over(turn), F.col("lon0") * F.col("k")).alias("xn"), F.coalesce(F.lead("y").over(turn), F.col("lat0") * 110574.0).alias("yn"))
    return closed.groupBy(key).agg((F.abs(F.sum(F.col("x") * F.col("yn") - F.col("xn") * F.col("y"))) / 2 / math.pow(10, 4)).alias("area_ha"))
