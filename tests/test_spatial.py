"""Radius joins against all pairs, at every latitude and across the date line."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrapace.functions.geo import EARTH_RADIUS_M
from terrapace.operators import corridor, matching, spatial


def metres(a, b):
    (x1, y1), (x2, y2) = ((math.radians(c) for c in p) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1, h)))


def cloud(lon, lat, n, spread_m, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        y = max(-90.0, min(90.0, lat + rng.uniform(-1, 1) * spread_m / 111000))
        x = lon + rng.uniform(-1, 1) * spread_m / 111000 / max(1e-6, math.cos(math.radians(y)))
        out.append(((x + 180) % 360 - 180, y))
    return out


@pytest.mark.parametrize("lon,lat", [(27.1, 0.0), (27.1, 38.4), (10.0, 65.0), (-50.0, -70.0), (25.0, 85.0), (180.0, 52.0), (-180.0, -66.6), (0.0, 89.999), (0.0, -90.0)])
def test_within_finds_every_pair(spark, lon, lat):
    points = cloud(lon, lat, 250, 600, 1)
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k long, lon double, lat double")
    for radius in (100.0, 900.0):
        got = {(r.k, r.j) for r in spatial.within(frame, frame.withColumnRenamed("k", "j"), radius).select("k", "j").collect()}
        assert got == {(i, j) for i, a in enumerate(points) for j, b in enumerate(points) if metres(a, b) <= radius}


@pytest.mark.parametrize("lon,lat", [(27.1, 38.4), (10.0, 70.0), (179.9999, 10.0)])
def test_radius_of_its_own_for_each_row(spark, lon, lat):
    points, rng = cloud(lon, lat, 200, 500, 2), random.Random(3)
    reach = [rng.choice([0.0, 5.0, 30.0, 120.0, 2000.0]) for _ in points]
    left = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k long, lon double, lat double")
    right = spark.createDataFrame([(k, *p, r) for k, (p, r) in enumerate(zip(points, reach))], "j long, lon double, lat double, reach double")
    found = spatial.within(left, right, F.col("reach"), cell_m=40.0).select("k", "j").collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == {(i, j) for i, a in enumerate(points) for j, b in enumerate(points) if metres(a, b) <= reach[j]}


@pytest.mark.parametrize("lat", [0.0, 65.0, 85.0])
def test_segments_reach_all_points_beside_them(spark, lat):
    points, ends = cloud(20.0, lat, 150, 400, 4), cloud(20.0, lat, 40, 400, 5)
    lines = list(zip(ends[::2], ends[1::2]))
    places = spark.createDataFrame([(1, k, *p) for k, p in enumerate(points)], "track_id long, seq long, lon double, lat double")
    segments = spark.createDataFrame([(k, 100 + k, *a, *b) for k, (a, b) in enumerate(lines)], "u long, v long, lon1 double, lat1 double, lon2 double, lat2 double")

    def foot(p, a, b):
        c = math.cos(math.radians((a[1] + b[1]) / 2))
        ex, ey = (b[0] - a[0]) * c, b[1] - a[1]
        t = max(0, min(1, ((p[0] - a[0]) * c * ex + (p[1] - a[1]) * ey) / (ex * ex + ey * ey)))
        return metres(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))

    near = {k: sorted((foot(p, a, b), u) for u, (a, b) in enumerate(lines)) for k, p in enumerate(points)}
    got = matching.edge_candidates(places, segments).select("seq", "u").collect()
    assert {tuple(r) for r in got} == {(k, u) for k, found in near.items() for d, u in found[: matching.CANDIDATES] if d <= 35.0}
    routes = spark.createDataFrame([(k, 1, *a, *b) for k, (a, b) in enumerate(lines)], "route_id long, seq long, lon double, lat double, lon2 double, lat2 double")
    assets = places.select(F.col("seq").alias("asset"), "lon", "lat")
    beside = {(r.asset, r.route_id) for r in corridor.along_routes(assets, "asset", routes, 50.0).collect()}
    for k, found in near.items():
        for d, u in found:
            if abs(d - 50) > 1:  # the corridor measures on a plane
                assert ((k, u) in beside) == (d < 50)
