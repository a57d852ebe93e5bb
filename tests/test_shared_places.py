"""Rows that stand at one place share their routes."""

import os

from pyspark.sql import functions as F

from terrapace.plans import network, trips

SF = "/root/testdata/sf0.001"
#: Facilities and zones this many keys apart stand at one place and start from one facility.
PERIOD = 97 * 89 * 10


def doubled(spark, folder):
    for name in os.listdir(SF):
        table = spark.read.parquet(f"{SF}/{name}")
        for t, key in (("supplier", "s_suppkey"), ("customer", "c_custkey")):
            if name == f"{t}.parquet":
                table = table.union(table.withColumn(key, F.col(key) + PERIOD))
        table.write.parquet(f"{folder}/{name}")
    return str(folder)


def sizes_of(monkeypatch):
    sizes, stored = {}, network.network.stored
    monkeypatch.setattr(network.network, "stored", lambda df, name: [kept := stored(df, name), sizes.__setitem__(name, kept.count())][0])
    return sizes


def test_evacuation_asks_each_place_once(spark, tmp_path, monkeypatch):
    sizes = sizes_of(monkeypatch)
    want, once = network.QUERIES["a31_evacuation"](spark, SF).collect(), dict(sizes)
    got = network.QUERIES["a31_evacuation"](spark, doubled(spark, tmp_path / "d")).collect()
    assert set(got) == set(want) and len(want) == len(got) and sizes["pairs"] == once["pairs"] > 0


def test_legs_between_the_same_places_are_one_route(spark, tmp_path, monkeypatch):
    sizes = sizes_of(monkeypatch)
    want, once = trips.QUERIES["g07_segment_route"](spark, SF).collect(), dict(sizes)
    got = trips.QUERIES["g07_segment_route"](spark, doubled(spark, tmp_path / "d")).collect()
    # A facility of the first ten is unlike its double, so only zones are doubled here.
    assert {r for r in got if r.leg_id < PERIOD} == set(want) and {(r.leg_id % PERIOD, *r[1:]) for r in got} == {tuple(r) for r in want}
    assert len(got) == 2 * len(want) and sizes["firsts"] == once["firsts"] > 0
