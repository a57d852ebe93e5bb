"""Relief: slope and aspect of segments, hillshade by tiles, planes through groups of points, thinned points, and ordered digests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinematics
from ..functions.geo import haversine_2d
from ..functions.numbers import is_finite
from .fixpoint import Rounds
from .network import stored
from .spatial import within

# Light from the north-west at 45 degrees (east, north, up), and how much heights are stretched; least metres of a segment with a slope.
LIGHT, STRETCH, LEAST_M = (-0.5, 0.5, 0.5**0.5), 5.0, 0.1
# Fixed values of the blend: least distance and power of its weights, and metres at which the plane begins and has taken over.
NEAREST_M, POWER, PLANE_FROM_M, PLANE_AT_M = 10.0, 1.6, 20.0, 80.0
#: Cells of a tile's side.
TILE = 256


def slope_and_aspect(lon1, lat1, z1, lon2, lat2, z2, azimuth_deg: float = 180.0, elevation_deg: float = 55.0) -> tuple[Column, Column, Column]:
    """(slope %, direction in degrees from north, sunlight 0 to 1) of the way between two points: (0, 0, 0.5) where they are no LEAST_M apart, (0, 0, 1) without heights."""
    lon1, lat1, z1, lon2, lat2, z2 = (F.col(c) if isinstance(c, str) else c for c in (lon1, lat1, z1, lon2, lat2, z2))
    d = haversine_2d(lon1, lat1, lon2, lat2)
    known = is_finite(z1) & is_finite(z2)
    apart = is_finite(lon1 + lat1 + lon2 + lat2) & (d >= LEAST_M)
    whole = F.coalesce(apart & known, F.lit(False))
    slope = F.when(whole, (z2 - z1) / d * 100.0).otherwise(0.0)
    bearing = F.degrees(F.atan2((lon2 - lon1) * F.cos(F.radians((lat1 + lat2) * 0.5)), lat2 - lat1))
    aspect = F.when(whole, F.pmod(bearing + 360.0, F.lit(360.0))).otherwise(0.0)
    light = F.when(~F.coalesce(apart, F.lit(False)), 0.5).when(~whole, 1.0).otherwise(kinematics.aspect_factor(aspect, slope, azimuth_deg, elevation_deg))
    return slope, aspect, light


def hillshade(cells: DataFrame, dx_m: float, dy_m: float, side: int = TILE) -> DataFrame:
    """(i, j, shade 0 to 1) of cells(i to the east, j to the north, value); beyond the raster, and where a value is missing, the cell's own height stands in.

    Every tile gets its cells and the rim of its neighbours: only the rims are copied, and each tile is one group of numpy work.
    """
    known = cells.where("value is not null and not isnan(value)").select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("value").cast("double"))
    spots = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + k) / side).cast("long") for k in (-1, 0, 1))))
    tiles = known.withColumn("ti", F.explode(spots("i"))).withColumn("tj", F.explode(spots("j")))
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("shade", pa.float64())])

    def shade(key, table):
        i0, j0 = key[0].as_py() * side - 1, key[1].as_py() * side - 1
        h = np.full((side + 2, side + 2), np.nan)
        i, j = (table[c].to_numpy() for c in ("i", "j"))
        inside = (i >= i0) & (i < i0 + side + 2) & (j >= j0) & (j < j0 + side + 2)
        h[i[inside] - i0, j[inside] - j0] = table["value"].to_numpy()[inside]
        own = h[1:-1, 1:-1]
        near = lambda x: np.where(np.isnan(x), own, x)
        sx = (near(h[2:, 1:-1]) - near(h[:-2, 1:-1])) / (2 * dx_m) * STRETCH
        sy = (near(h[1:-1, 2:]) - near(h[1:-1, :-2])) / (2 * dy_m) * STRETCH
        value = np.maximum(0.0, (-sx * LIGHT[0] - sy * LIGHT[1] + LIGHT[2]) / np.sqrt(sx * sx + sy * sy + 1))
        a, b = np.nonzero(~np.isnan(own))
        return pa.table([pa.array(a + i0 + 1), pa.array(b + j0 + 1), pa.array(value[a, b])], schema=schema)

    return tiles.groupBy("ti", "tj").applyInArrow(shade, "i long, j long, shade double")


def planes(points: DataFrame, group: str) -> DataFrame:
    """(group, n, mx, my, mz, gx, gy): the least-squares plane z = mz + gx (x - mx) + gy (y - my) of each group of points(group, x, y, z); flat where they lie on a line.

    Covariances are merged from partial ones, centred on their own means, so a group of any size costs no single task.
    """
    c = lambda a, b: F.covar_pop(a, b)
    sums = points.groupBy(group).agg(F.count("*").alias("n"), *(F.avg(k).alias(f"m{k}") for k in "xyz"), c("x", "x").alias("xx"), c("y", "y").alias("yy"), c("x", "y").alias("xy"), c("x", "z").alias("xz"), c("y", "z").alias("yz"))
    n = F.col("n").cast("double")
    det = (F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")) * n * n
    g = lambda top: F.when(F.abs(det) > 1e-4, top * n * n / det).otherwise(0.0)
    return sums.select(group, "n", "mx", "my", "mz", g(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")).alias("gx"), g(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")).alias("gy"))


def blended_heights(spots: DataFrame, key: str, points: DataFrame, group: str) -> DataFrame:
    """(key, z) of spots(key, group, x, y): near its group's points the inverse-distance mean of their heights, farther off their plane."""
    plane = planes(points, group)
    pairs = spots.join(points.select(F.col(group).alias("__g"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz")), F.col(group) == F.col("__g"))
    d = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    w = 1.0 / F.pow(F.greatest(F.lit(NEAREST_M), F.col("__d")), POWER)
    near = pairs.withColumn("__d", d).groupBy(key, group, "x", "y").agg((F.sum(F.col("pz") * w) / F.sum(w)).alias("local"), F.min("__d").alias("__least"))
    blend = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("__least") - PLANE_FROM_M) / (PLANE_AT_M - PLANE_FROM_M)))
    far = F.col("mz") + F.col("gx") * (F.col("x") - F.col("mx")) + F.col("gy") * (F.col("y") - F.col("my"))
    return near.join(plane, group).select(key, ((1.0 - blend) * F.col("local") + blend * far).alias("z"))


def thinned(points: DataFrame, key: str, spacing_m: float) -> DataFrame:
    """The keys of points(key, lon, lat) that stay when they are taken in order and each goes that has one that stayed nearer than spacing_m.

    That is the first independent set of the graph of near points, found in rounds: a point stays when all smaller neighbours are gone, and goes when one
    stays. Rounds store what they decide; their number is the longest chain of decisions, not the number of points. Of points of one place only the
    first can stay, so the graph has its places. Points without a place stay.
    """
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    firsts = points.where(placed).groupBy("lon", "lat").agg(F.min(key).alias(key)) if spacing_m > 0 else points.where(placed)
    slim = stored(firsts.select(key, "lon", "lat").union(points.where(~placed).select(key, "lon", "lat")), "places")
    near = within(slim, slim.withColumnRenamed(key, "__k"), spacing_m, "__d").where((F.col("__d") < spacing_m) & (F.col(key) > F.col("__k")))
    edges = stored(near.select(F.col(key).alias("a"), F.col("__k").alias("b")), "near")
    free = slim.select(F.col(key).alias("p")).join(edges.select(F.col("a").alias("p")).distinct(), "p", "left_anti")
    decided = Rounds(free.select("p", F.lit(True).alias("stays")), "thinned")
    while decided.last().take(1):
        done = decided.all().select("p", "stays")
        open_ = edges.join(done.select(F.col("p").alias("a")), "a", "left_anti")
        judged = open_.join(done.select(F.col("p").alias("b"), "stays"), "b", "left").groupBy(F.col("a").alias("p")).agg(F.max(F.coalesce("stays", F.lit(False))).alias("met"), F.count_if(F.col("stays").isNull()).alias("waiting"))
        decided.add(judged.where("met or waiting = 0").select("p", (~F.col("met")).alias("stays")))
    return decided.all().where("stays").select(F.col("p").alias(key))


def ordered_digest(rows: DataFrame, group: str, seq: str, columns: list[str]) -> DataFrame:
    """(group, n, digest): a digest that knows the order of rows and of columns, and doesn't depend on how they are dealt.

    Every row's place and values make 60 bits of an MD5; these are summed modulo 2**60, so parts of a group are merged in any order, and swapped rows
    change the sum. columns are text expressions of the values.
    """
    text = F.concat_ws("|", F.col(seq).cast("string"), *(F.coalesce(F.expr(c).cast("string"), F.lit("-")) for c in columns))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    total = F.sum(bits) % F.lit(str(1 << 60)).cast("decimal(20,0)")
    return rows.groupBy(group).agg(F.count("*").alias("n"), total.cast("long").alias("digest"))
