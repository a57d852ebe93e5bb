"""Ordered folds by blocks, and tracks matched on streets of any number."""

import pytest
from pyspark.sql import functions as F

from terrapace.functions.numbers import rounded
from terrapace.operators import chains, matching, search, spatial

STEP = 0.0005
NODES = [(10 * i + j, 27.0 + j * STEP, 38.0 + i * STEP, float(i)) for i in range(4) for j in range(4)]


@pytest.fixture(scope="module")
def streets(spark):
    at = {n: (lon, lat, z) for n, lon, lat, z in NODES}
    pairs = [(n, n + d) for n in at for d in (1, 10) if n + d in at and (n, n + d) != (11, 12)]  # one street is missing
    rows = [(u, v, at[u][0], at[u][1], at[u][2], at[v][0], at[v][1], at[v][2]) for u, v in pairs]
    segments = spark.createDataFrame(rows, "u long, v long, lon1 double, lat1 double, z1 double, lon2 double, lat2 double, z2 double")
    return segments, spark.createDataFrame(NODES, "node long, lon double, lat double, z double")


def test_blocks_give_what_a_walk_gives(spark):
    rows = spark.range(40).select((F.col("id") % 2).alias("key"), F.floor(F.col("id") / 2).alias("at"), F.array((F.col("id") % 3 + 1), (F.col("id") % 5)).alias("f"))
    first = spark.createDataFrame([(0, 7), (1, 1)], "key long, state long")
    mod = lambda x: F.pmod(x, F.lit(1_000_003).cast("long"))
    compose = lambda f, g: F.array(mod(f[0] * g[0]), mod(f[1] * g[0] + g[1]))
    got = {(r.key, r["at"]): r.state for r in chains.scan(rows, first, lambda s, f: mod(s * f[0] + f[1]), compose, block=3).collect()}  # four levels
    want = {}
    for key, state in ((0, 7), (1, 1)):
        for at in range(20):
            i = 2 * at + key
            state = (state * (i % 3 + 1) + i % 5) % 1_000_003
            want[key, at] = state
    assert got == want


def test_tracks_follow_streets_the_same_on_any_graph(spark, streets, monkeypatch):
    segments, nodes = streets
    noise = 0.00004
    points = [(1, k, 27.0 + k * STEP / 2, 38.0 + STEP + noise) for k in range(7)]  # along a line that lacks its middle
    points += [(2, 5, 27.0, 38.0 - 0.02), (2, 9, 27.0, 38.0), (2, 10, None, 38.0), (2, 11, 27.0, 38.0 + STEP)]  # starts two kilometres off
    points += [(3, 1, 27.0, 38.0)]
    points = spark.createDataFrame(points, "track_id long, seq long, lon double, lat double")
    got = sorted(tuple(r) for r in matching.match_tracks(points, segments, nodes).collect())
    assert [r[:2] for r in got] == [(1, k) for k in range(7)] + [(2, 5), (2, 9), (2, 11)]
    bare = got[7]
    assert bare[3] == bare[4] == 0 and 2200 < bare[7] < 2250
    assert all({r[3], r[4]} <= {n[0] for n in NODES} for r in got)
    assert not any((r[3], r[4]) == (11, 12) for r in got)
    monkeypatch.setattr(search, "MOST_BROADCAST_EDGES", 0)
    assert sorted(tuple(r) for r in matching.match_tracks(points, segments, nodes).collect()) == got
    one = {r.track_id: r for r in matching.match_summary(spark.createDataFrame(got, "track_id long, seq long, n long, u long, v long, lon double, lat double, residual_m double, z double")).collect()}
    assert one[2].points == 3 and abs(one[2].gain_m - 1.0) < 1e-9


def test_nearest_at_any_distance(spark):
    left = spark.createDataFrame([(1, 27.0, 38.0), (2, 27.0, 38.0), (3, -150.0, -40.0), (4, 27.001, 38.0)], "k long, lon double, lat double")
    right = spark.createDataFrame([(7, 27.0, 38.001), (8, 27.0011, 38.0), (9, 30.0, 60.0)], "node long, lon double, lat double")
    got = {r.k: r.node for r in spatial.nearest_anywhere(left, right, "node", 50.0).collect()}
    assert {k: got[k] for k in (1, 2, 4)} == {1: 8, 2: 8, 4: 8}
    assert got[3] == 9
    assert spatial.nearest_anywhere(left, right.limit(0), "node", 50.0).count() == 0
    assert spatial.nearest_anywhere(left.limit(0), right, "node", 50.0).count() == 0


def test_candidates_are_searched_in_many_tasks(spark, streets):
    segments, _ = streets
    points = spark.createDataFrame([(1, k, 27.0 + k * STEP / 7, 38.0 + k * STEP / 9) for k in range(20)] + [(2, 1, 179.9999, 38.0)], "track_id long, seq int, lon double, lat double")
    far = spark.createDataFrame([(90, 91, -179.9999, 37.9999, 0.0, -179.9999, 38.0002, 0.0)], segments.schema)  # beyond the date line, 17.5 metres off
    found = matching.edge_candidates(points, segments.union(far), 35.0)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.track_id, r.seq, r.u, r.v) for r in found.collect()}
    both = points.crossJoin(segments.union(far)).withColumn("k", F.cos(F.radians((F.col("lat1") + F.col("lat2")) / 2)))
    both = both.withColumns({"ex": F.expr("(lon2 - lon1) * k"), "ey": F.expr("lat2 - lat1")}).withColumn("share", F.expr("greatest(0e0, least(1e0, ((lon - lon1) * k * ex + (lat - lat1) * ey) / (ex * ex + ey * ey)))"))
    metres = matching.haversine_2d("lon", "lat", F.expr("lon1 + share * (lon2 - lon1)"), F.expr("lat1 + share * (lat2 - lat1)"))
    assert got == {(r.track_id, r.seq, r.u, r.v) for r in both.where(metres <= 35.0).collect()} and (2, 1, 90, 91) in got


def test_ways_are_looked_up_once_for_each_pair_of_streets(spark, streets, monkeypatch):
    segments, nodes = streets
    points = [(t, k, 27.0 + k * STEP / 4, 38.0 + STEP + 0.00004) for t in range(6) for k in range(9)]
    sizes, stored = {}, matching.stored
    monkeypatch.setattr(matching, "stored", lambda df, name: [kept := stored(df, name), sizes.__setitem__(name, kept.count())][0])
    matching.match_tracks(spark.createDataFrame(points, "track_id long, seq int, lon double, lat double"), segments, nodes).collect()
    assert 0 < sizes["streets"] <= sizes["hops"] / 6


def test_halves_round_as_in_sql(spark):
    assert spark.createDataFrame([(38.40300075,), (-0.5,)], "x double").select(rounded("x", 7).alias("r"), rounded("x", 0).alias("w")).collect() == [(38.4030007, 38.0), (-0.5, -1.0)]
