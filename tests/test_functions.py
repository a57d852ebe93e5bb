"""Published values and invariants of the scalar functions and searches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrapace.functions import access, geo, impedance, solar
from terrapace.functions import kinematics as K
from terrapace.functions.profiles import PROFILES, profiles
from terrapace.operators import equity, network, polyline, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_minetti_at_published_slopes(spark):
    per_kg_m = lambda s: one(spark, K.minetti_kcal(F.lit(s), 1.0, 1.0)) * 4184
    assert abs(per_kg_m(0.0) - 2.5) < 1e-9
    assert abs(per_kg_m(0.10) - 4.90) < 0.20
    assert abs(per_kg_m(0.45) - 17.60) < 0.60


def test_tobler_at_published_slopes(spark):
    assert abs(one(spark, K.tobler_speed(F.lit(-0.05))) - 6.0) < 0.05
    assert abs(one(spark, K.tobler_speed(F.lit(0.0))) - 5.036) < 0.05


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf"), None])
def test_bad_numbers_fall_back(spark, bad):
    x = F.lit(bad).cast("double")
    for c in (K.tobler_speed(x), K.minetti_kcal(x), K.fatigue_decay(x, x), K.drag_watts(x), K.cyclist_speed(x), K.cycling_kcal(x), K.scooter_speed(x), K.vehicle_speed(F.lit(3), slope_pct=x), K.thermal_stress(x), K.aspect_factor(x, x), geo.haversine_2d(x, x, F.lit(1.0), F.lit(1.0))):
        got = one(spark, c)
        assert got is not None and math.isfinite(got)


def test_gini(spark):
    for values, want in (([1.0, 2.0, 3.0, 4.0], 0.25), ([0.0, 0.0, 0.0, 0.0, 10.0], 0.8)):
        assert abs(equity.gini(spark.createDataFrame([(v,) for v in values], "x double"), "x").first().gini - want) < 1e-9


def test_sun_is_down_at_midnight_and_high_at_noon(spark):
    assert one(spark, solar.solar_position(F.lit(38.4), F.lit(0.0), F.lit(172)))["elevation_deg"] == 0
    assert one(spark, solar.solar_position(F.lit(38.4), F.lit(12.0), F.lit(172)))["elevation_deg"] > 70


def test_access_of_a_one_way_street(spark):
    tags = {k: F.lit("") for k in ("access", "foot", "bicycle", "motor_vehicle", "lit", "oneway_bicycle", "oneway_foot")} | {"highway": F.lit("residential"), "oneway": F.lit(True), "against_oneway": F.lit(True), "reverse_of_two_way": F.lit(False)}
    got = {r.profile: r.x.allowed for r in profiles(spark).select("profile", access.edge_access("profile", "category", tags).alias("x")).collect()}
    assert got["adult"] and not got["car"] and not got["bicycle"]


def test_missing_rasters_are_neutral(spark):
    row = lambda lst: profiles(spark).where("profile = 'adult'").select(impedance.edge_cost(F.lit(10.0), F.lit(0.0), F.lit(False), F.lit(1.0), F.lit(4), lst, None).alias("x")).first().x
    assert row(None) == row(F.lit(None).cast("double")) == 10.0 < row(F.lit(0.5))


def test_wheelchairs_take_no_stairs(spark):
    got = {r.profile: r.x for r in profiles(spark).select("profile", impedance.edge_cost(F.lit(10.0), F.lit(0.0), F.lit(True), F.lit(1.0), F.lit(5)).alias("x")).collect()}
    assert {k for k, v in got.items() if v is None} == {p[0] for p in PROFILES if not p[5]}


def grid(spark, n=6, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        for j in range(n):
            rows += [(i * n + j, k, r.random() + 0.1) for k in (((i + 1) * n + j) if i + 1 < n else None, (i * n + j + 1) if j + 1 < n else None) if k is not None]
    return spark.createDataFrame([x for u, v, c in rows for x in ((u, v, c), (v, u, c * 1.5))], "u long, v long, cost double")


def test_searches_agree(spark):
    edges = grid(spark)
    origins = spark.createDataFrame([(0,), (17,), (999,)], "origin long")
    key = lambda df: sorted((r.origin, r.node, round(r.cost, 9)) for r in df.where("node < 100").collect())
    tree = search.shortest_paths(edges, origins)
    assert key(tree) == key(search.relaxed_paths(edges, origins.where("origin < 100")))
    near = search.shortest_paths(edges, origins, limit=1.0)
    assert key(near) == [x for x in key(tree) if x[2] <= 1.0]
    assert [tuple(r) for r in tree.where('origin = 999').collect()] == [(999, 999, 0.0, -1)]
    goals = spark.createDataFrame([(5,), (30,)], "node long")
    assert key(search.shortest_paths(edges, origins, goals=goals)) == [x for x in key(tree) if x[1] in (5, 30)]


def test_predecessors_add_up(spark):
    edges = {(r.u, r.v): r.cost for r in grid(spark).collect()}
    rows = search.shortest_paths(grid(spark), spark.createDataFrame([(0,)], "origin long")).collect()
    cost = {r.node: r.cost for r in rows}
    assert all(r.pred == -1 or abs(cost[r.pred] + edges[r.pred, r.node] - r.cost) < 1e-9 for r in rows) and len(rows) == 36


def test_components_and_heights(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (9, 8), (5, 5)], "u long, v long")
    assert {r.node: r.component for r in network.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    nodes = spark.createDataFrame([(1, 10.0), (2, None), (3, None), (7, None)], "node long, z double")
    assert {r.node: r.z for r in network.fill_heights(nodes, edges).collect()} == {1: 10.0, 2: 10.0, 3: 10.0, 7: 0.0}


def test_heights_are_filled_however_deep(spark, monkeypatch):
    """With ranges held to three rounds, so that a hole of six rings stands for one deeper than any count of rounds."""
    monkeypatch.setattr(network, "range", lambda n: range(min(n, 3)), raising=False)
    nodes = spark.createDataFrame([(0, 7.0)] + [(i, None) for i in range(1, 7)] + [(9, None)], "node long, z double")
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "u long, v long")
    assert {r.node: r.z for r in network.fill_heights(nodes, edges).collect()} == {i: 7.0 for i in range(7)} | {9: 0.0}


def test_steps_keep_the_length(spark):
    points = spark.createDataFrame([(1, 1, 27.0, 38.0, 5.0), (1, 2, 27.001, 38.0, 9.0), (1, 3, 27.001, 38.002, 2.0)], "route_id long, seq long, lon double, lat double, z double")
    totals = polyline.route_totals(polyline.steps(points)).first()
    straight = sum(r.d for r in points.selectExpr("*", "lead(lon) over (order by seq) lon2", "lead(lat) over (order by seq) lat2").where("lon2 is not null").select(geo.haversine_2d("lon", "lat", "lon2", "lat2").alias("d")).collect())
    assert straight < totals.distance_m < straight * 1.01
    assert abs(totals.gain_m - 4.0) < 1e-9 and abs(totals.loss_m - 7.0) < 1e-9


def test_routes_cost_what_searches_cost(spark):
    edges = grid(spark)
    pairs = spark.createDataFrame([(1, 0, 35), (2, 0, 7), (3, 14, 14), (4, 0, 999), (5, 999, 0)], "pair_id long, origin long, node long")
    cost = {(r.origin, r.node): r.cost for r in search.shortest_paths(edges, pairs.select("origin")).collect()}
    step = {(r.u, r.v): r.cost for r in edges.collect()}
    got = {r.pair_id: r for r in search.routes(edges, pairs).collect()}
    assert set(got) == {1, 2, 3}
    for k, (a, b) in {1: (0, 35), 2: (0, 7), 3: (14, 14)}.items():
        path = got[k].path
        assert (path[0], path[-1]) == (a, b) and abs(got[k].cost - cost[a, b]) < 1e-9
        assert abs(sum(step[x] for x in zip(path, path[1:])) - got[k].cost) < 1e-9


def test_turns_cost(spark):
    """A way with one left turn against a longer one without: the turn decides."""
    places = spark.createDataFrame([(0, 27.0, 38.0), (1, 27.001, 38.0), (2, 27.001, 38.001), (3, 27.002, 38.0)], "node long, lon double, lat double")
    edges = spark.createDataFrame([(0, 1, 80.0), (1, 2, 80.0), (1, 3, 80.0), (1, 0, 80.0), (2, 1, 80.0), (3, 1, 80.0)], "u long, v long, cost double")
    model = spark.createDataFrame([("car", 6.0, 2.0, 4.0, None, 30.0)], "profile string, left_s double, right_s double, sharp_s double, uturn_s double, dead_end_s double")
    steps = search.turn_graph(edges, places, network.degrees(edges), model, 10.0)
    got = {r.node: round(r.cost, 6) for r in search.turn_paths(steps, spark.createDataFrame([(0,)], "origin long")).collect()}
    assert got == {0: 0.0, 1: 80.0, 3: 160.0, 2: 160.0 + 60.0}


def test_a_track_is_matched_to_its_street(spark):
    from terrapace.operators import matching

    segments = spark.createDataFrame([(1, 2, 27.0, 38.0, 27.001, 38.0), (2, 3, 27.001, 38.0, 27.002, 38.0), (4, 5, 27.0, 38.0002, 27.002, 38.0002)], "u long, v long, lon1 double, lat1 double, lon2 double, lat2 double")
    track = spark.createDataFrame([(1, k, 27.0 + k * 0.0002, 38.0 + (0.00012 if k == 4 else 0.00002)) for k in range(1, 9)], "track_id long, seq long, lon double, lat double")
    edges = segments.select("u", "v", geo.haversine_2d("lon1", "lat1", "lon2", "lat2").alias("cost"))
    rows = matching.match_tracks(matching.edge_candidates(track, segments), edges).orderBy("seq").collect()
    assert len(rows) == 8 and {(r.u, r.v) for r in rows} == {(1, 2), (2, 3)}


def test_evacuation_avoids_a_hazard(spark):
    from terrapace.operators import corridor

    routes = spark.createDataFrame([(1, 60.0), (2, 120.0)], "pair_id long, cost double")
    points = spark.createDataFrame([(1, 1, 27.0, 38.0), (1, 2, 27.001, 38.0), (2, 1, 27.0, 38.01)], "route_id long, seq int, lon double, lat double")
    pairs = spark.createDataFrame([(1, 0, 7), (2, 0, 8)], "pair_id long, origin long, muster long")
    hazards = spark.createDataFrame([(1, 27.001, 38.0, 50.0, 100.0)], "hazard_id int, lon double, lat double, radius_m double, severity double")
    assert corridor.evacuation(routes, points, pairs, hazards).first().muster == 8


def test_file_events(spark, tmp_path):
    from terrapace.streaming import changes

    spark.range(3).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    events = changes.file_events(spark, str(tmp_path / "in"), "id long")
    changes.on_change(events, lambda df, epoch: seen.append(df.count()), str(tmp_path / "c")).awaitTermination()
    spark.range(2).write.mode("append").parquet(str(tmp_path / "in"))
    changes.on_change(events, lambda df, epoch: seen.append(df.count()), str(tmp_path / "c")).awaitTermination()
    assert seen == [3, 2]
