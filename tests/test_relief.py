"""Relief operators at their edges: tiles, chains of near points, flat and unknown heights, swapped rows."""

import math
import random

import pytest

from terrapace.operators import relief, spatial


def test_tiles_do_not_show(spark):
    rng = random.Random(1)
    cells = [(i, j, rng.uniform(0, 30) if rng.random() > 0.1 else None) for i in range(-5, 12) for j in range(9)]
    frame = spark.createDataFrame(cells, "i long, j long, value double")
    shades = [{(r.i, r.j): round(r.shade, 12) for r in relief.hillshade(frame, 40.0, 50.0, side).collect()} for side in (1, 4, 100)]
    assert shades[0] == shades[1] == shades[2] and set(shades[0]) == {(i, j) for i, j, v in cells if v is not None}
    flat = relief.hillshade(spark.createDataFrame([(0, 0, 5.0), (1, 0, 5.0), (0, 1, float("nan"))], "i long, j long, value double"), 40.0, 50.0).collect()
    assert [r.shade for r in flat] == [pytest.approx(math.sqrt(0.5))] * 2 and relief.hillshade(frame.limit(0), 40.0, 50.0).count() == 0


def test_points_are_thinned_in_order(spark):
    line = [(k, 27.0 + k * 0.00003, 70.0) for k in range(60)] + [(100, 27.0, 70.0), (200, 50.0, 0.0)]  # 1.1 m apart
    kept = {r.k for r in relief.thinned(spark.createDataFrame(line, "k long, lon double, lat double"), "k", 5.0).collect()}
    want = []
    for k, x, y in line:
        if all(relief_metres((x, y), p) >= 5.0 for _, p in want):
            want.append((k, (x, y)))
    assert kept == {k for k, _ in want} and 200 in kept and 100 not in kept


def relief_metres(a, b):
    (x1, y1), (x2, y2) = ((math.radians(c) for c in p) for p in (a, b))
    return 2 * 6371008.8 * math.asin(math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2))


def test_slopes_of_odd_segments(spark):
    nan = float("nan")
    rows = [(1, 27.0, 38.0, 10.0, 27.0, 38.001, 20.0), (2, 27.0, 38.0, 10.0, 27.0, 38.0, 20.0), (3, 27.0, 38.0, None, 27.0, 38.001, 20.0), (4, nan, 38.0, 1.0, 27.0, 38.001, 20.0), (5, 27.001, 38.0, 10.0, 27.0, 38.0, 10.0)]
    frame = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, e double, f double")
    slope, aspect, light = relief.slope_and_aspect("a", "b", "c", "d", "e", "f")
    got = {r.k: (round(r.s, 3), round(r.t, 3), round(r.l, 3)) for r in frame.select("k", slope.alias("s"), aspect.alias("t"), light.alias("l")).collect()}
    assert got[1][0] == pytest.approx(8.993, abs=0.01) and got[1][1] == 0.0 and got[2] == (0.0, 0.0, 0.5) and got[3] == (0.0, 0.0, 1.0) and got[4] == (0.0, 0.0, 0.5) and got[5][:2] == (0.0, 270.0)


def test_planes_and_blends(spark):
    plane = [(1, x, y, 3 + 0.5 * x - 0.25 * y) for x in (0.0, 7.0, 90.0) for y in (0.0, 5.0, 80.0)]
    line = [(2, x, x, x) for x in (0.0, 1.0, 2.0)] + [(3, 4.0, 4.0, 9.0)]
    points = spark.createDataFrame(plane + line, "g int, x double, y double, z double")
    found = {r.g: r for r in relief.planes(points, "g").collect()}
    assert (found[1].gx, found[1].gy) == (pytest.approx(0.5), pytest.approx(-0.25)) and (found[2].gx, found[2].gy) == (0.0, 0.0) and found[3].mz == 9.0
    spots = spark.createDataFrame([(1, 1, 1000.0, 0.0), (2, 3, 4.0, 4.0), (3, 3, 4.0, 500.0)], "k int, g int, x double, y double")
    heights = {r.k: r.z for r in relief.blended_heights(spots, "k", points, "g").collect()}
    assert heights == {1: pytest.approx(503.0), 2: 9.0, 3: 9.0}


def test_digests_know_the_order(spark):
    rows = [(g, k, f"v{k * 7 % 5}", None if k == 2 else 1.5) for g in (1, 2) for k in range(30)]
    frame = spark.createDataFrame(rows, "g int, k int, a string, b double")
    digest = lambda df: {r.g: (r.n, r.digest) for r in relief.ordered_digest(df, "g", "k", ["a", "b"]).collect()}
    first = digest(frame.repartition(1))
    assert first == digest(frame.repartition(7)) and first[1] == first[2]
    swapped = [(g, {3: 4, 4: 3}.get(k, k) if g == 1 else k, a, b) for g, k, a, b in rows]
    other = digest(spark.createDataFrame(swapped, frame.schema))
    assert other[1] != first[1] and other[2] == first[2]


def test_of_one_place_only_the_first_point_counts(spark, monkeypatch):
    """Near pairs are those of places, so copies of a place don't make the graph grow."""
    paired = []
    monkeypatch.setattr(relief, "within", lambda *a: paired.append(spatial.within(*a)) or paired[-1])
    rows = [(100 * k + c, 27.0 + k * 0.00003, 70.0) for k in range(4) for c in range(30)] + [(901, None, 70.0), (902, None, 70.0)]
    kept = {r.k for r in relief.thinned(spark.createDataFrame(rows, "k long, lon double, lat double"), "k", 2.0).collect()}
    assert kept == {0, 200, 901, 902} and paired[0].count() <= 16
