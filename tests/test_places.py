"""Rows that share a place share its search: results are those of all pairs, and pairs are of places."""

import math
import random

from terrapace.operators import equity, spatial

RNG = random.Random(5)
SPOTS = [(27.1 + k % 4 * 0.003, 38.4 + k // 4 * 0.003) for k in range(12)]


def frame(spark, name, n):
    return spark.createDataFrame([(k, *SPOTS[RNG.randrange(12)], 1.0 + k % 7) for k in range(n)], f"{name} long, lon double, lat double, amount double")


def test_the_few_nearest_of_crowded_places(spark):
    left, right = frame(spark, "a", 30), frame(spark, "b", 60)
    got = sorted(tuple(r) for r in spatial.nearest_few(left, right, "a", "b", 700.0, 7).select("a", "b", "place").collect())
    pairs = left.select("a", "lon", "lat").crossJoin(right.selectExpr("b", "lon as x", "lat as y")).withColumn("d", spatial.haversine_2d("lon", "lat", "x", "y")).where("d <= 700")
    want = pairs.selectExpr("a", "b", "row_number() over (partition by a order by d, b) as place").where("place <= 7").collect()
    assert got == sorted(tuple(r) for r in want)


def test_nearest_takes_the_smaller_key_where_distances_agree_to_a_micrometre(spark):
    left = spark.createDataFrame([(1, 27.0, 38.0)], "a long, lon double, lat double")
    right = spark.createDataFrame([(9, 27.0, 38.001), (5, 27.0, 37.999 - 1e-13), (7, 27.0, 38.001)], "b long, lon double, lat double")
    row = spatial.nearest(left, right, "a", "b", 500.0).first()
    assert row.b == 5 and abs(row.distance_m - 111.2) < 0.1


def test_access_scores_of_shared_places_pair_places_only(spark):
    zones = frame(spark, "zone_id", 40).withColumnRenamed("amount", "population")
    facilities = frame(spark, "facility_id", 30).withColumnRenamed("amount", "capacity")
    z, f = zones.collect(), facilities.collect()
    paired = []
    within = equity.within
    equity.within = lambda *a: paired.append(within(*a)) or paired[-1]
    try:
        got = {r.zone_id: r.score for r in equity.access_scores(zones, facilities, 700.0).collect()}
    finally:
        equity.within = within
    assert paired[0].count() <= 144  # of 1,200 pairs of rows

    def weight(a, b):
        k = math.cos(math.radians(a.lat)) * math.cos(math.radians(b.lat))
        h = math.sin(math.radians(b.lat - a.lat) / 2) ** 2 + k * math.sin(math.radians(b.lon - a.lon) / 2) ** 2
        d = 2 * 6371008.8 * math.asin(math.sqrt(h))
        return max(0.0, (math.exp(-0.5 * (d / 700) ** 2) - math.exp(-0.5)) / (1 - math.exp(-0.5))) if d <= 700 else 0.0

    demand = {b.facility_id: sum(a.population * weight(a, b) for a in z) for b in f}
    for a in z:
        assert abs(got[a.zone_id] - sum(b.capacity / demand[b.facility_id] * weight(a, b) for b in f if demand[b.facility_id] > 0)) < 1e-9
