"""Routes between places: statuses, ends, several stops, alternatives, and graphs searched by joins."""

import pytest

from terrapace.functions.profiles import turn_models
from terrapace.operators import network, search, trips
from terrapace.plans import network as plans

DIR = "/root/testdata/sf0.001"
#: Two loops joined by one street (3, 4), and a place apart.
STREETS = [(0, 1), (1, 3), (0, 2), (2, 3), (3, 4), (4, 5), (5, 7), (4, 6), (6, 7)]
PLACES = {0: (0, 1), 1: (1, 2), 2: (1, 0), 3: (2, 1), 4: (3, 1), 5: (4, 2), 6: (4, 0), 7: (5, 1), 8: (40, 1), 9: (41, 1)}
at = lambda n: (27.15 + PLACES[n][0] * 0.001, 38.43 + PLACES[n][1] * 0.001)


@pytest.fixture
def town(spark):
    edges = [(a, b, 100.0 + a) for u, v in STREETS for a, b in ((u, v), (v, u))] + [(8, 9, 100.0)]
    nodes = [(n, *at(n), 10.0 * n, 0 if n < 8 else 1) for n in PLACES]
    return spark.createDataFrame(edges, "u long, v long, cost double"), spark.createDataFrame(nodes, "node long, lon double, lat double, z double, component long")


def leg(k, a, b, dx=0.0, z=(None, None), dd=0.0):
    (x, y), (p, q) = at(a), at(b)
    return (k, x + dx, y, z[0], p + dd, q, z[1])


def test_statuses_and_ends(spark, town):
    edges, nodes = town
    legs = [leg(1, 0, 3), leg(2, 0, 3, dx=-0.0002, z=(77.0, None)), leg(3, 0, 0), leg(4, 0, 0, dx=0.0001), leg(5, 0, 7, dx=1.0), leg(6, 9, 8), leg(7, 0, 0, z=(5.0, 6.0))]
    frame = spark.createDataFrame(legs, "leg_id long, lon_o double, lat_o double, z_o double, lon_d double, lat_d double, z_d double")
    outcomes, points = trips.segments(edges, nodes, frame, 60.0)
    assert {r.leg_id: r.status for r in outcomes.collect()} == {1: "matched", 2: "matched", 3: "coincident", 4: "same_network_node", 5: "snap_failed", 6: "no_directed_path", 7: "coincident"}
    lines = {}
    for r in points.orderBy("leg_id", "seq").collect():
        lines.setdefault(r.leg_id, []).append((round(r.lon, 6), round(r.lat, 6), r.z))
    assert [p[2] for p in lines[1]] == [0.0, 10.0, 30.0] and [p[2] for p in lines[2]] == [77.0, 0.0, 10.0, 30.0]
    assert len(lines[3]) == 1 and lines[3][0][2] == 0.0 and [p[2] for p in lines[4]] == [0.0, 0.0] and lines[7][0][2] == 5.0 and set(lines) == {1, 2, 3, 4, 7}
    none, _ = trips.segments(edges.limit(0), nodes.limit(0), frame, 60.0)
    assert {r.status for r in none.collect()} == {"empty_graph"}


def test_trips_of_several_stops(spark, town):
    edges, nodes = town
    stops = [(1, 1, 0), (1, 2, 3), (1, 3, 7), (2, 1, 0), (2, 2, 9), (3, 1, 4), (4, 1, 0), (4, 2, 7), (4, 3, 3), (4, 4, 7)]
    frame = spark.createDataFrame([(t, k, *at(n), None) for t, k, n in stops], "trip_id long, stop_no int, lon double, lat double, z double")
    degrees = network.degrees(edges)
    model = turn_models(spark).where("profile = 'bicycle'")
    summary, points = trips.trips(edges, nodes, frame, 60.0, delays=(degrees, model))
    rows = {r.trip_id: r for r in summary.collect()}
    assert {t: r.status for t, r in rows.items()} == {1: "matched", 2: "no_directed_path", 3: "too_few_stops", 4: "matched"}
    line = [(round(r.lon, 6), round(r.lat, 6)) for r in points.where("trip_id = 1").orderBy("seq").collect()]
    assert line[0] == pytest.approx(at(0)) and line[-1] == pytest.approx(at(7)) and len(line) == len(set(line)) == 6
    assert rows[1].turn_delay_s > 0 and rows[1].distance_m == pytest.approx(rows[1].distance_m) and rows[2].distance_m is None and rows[2].turn_delay_s is None
    better, _ = trips.trips(edges, nodes, frame, 60.0, optimise=True)
    best = {r.trip_id: r for r in better.collect()}
    assert best[4].distance_m < rows[4].distance_m and best[4].status == "matched"
    layer = trips.route_layer(summary, "bicycle", "micromobility")
    assert len(layer.columns) == 14 and {r.status for r in layer.collect()} == {"matched", "no_directed_path", "too_few_stops"}


@pytest.mark.parametrize("broadcast", [True, False])
def test_alternatives_cross_the_only_bridge(spark, town, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(search, "MOST_BROADCAST_EDGES", 0)
    edges, nodes = town
    pairs = spark.createDataFrame([(1, 0, 7), (2, 3, 4), (3, 8, 9)], "pair_id long, origin long, node long")
    primary = search.routes(edges, pairs)
    first = {r.pair_id: r.path for r in primary.collect()}
    assert first == {1: [0, 1, 3, 4, 5, 7], 2: [3, 4], 3: [8, 9]}
    found = {r.pair_id: r for r in trips.alternatives(edges, nodes, pairs, primary).collect()}
    assert set(found) == {1} and found[1].path == [0, 2, 3, 4, 6, 7] and found[1].share < 0.9
    shut = search.routes(edges, pairs.join(primary.selectExpr("pair_id", "path as along"), "pair_id"), float("inf"))
    assert shut.count() == 0


def test_routes_by_joins_are_the_same(spark, monkeypatch):
    edges = plans._costed(spark, DIR, "adult", False)
    pairs = spark.createDataFrame([(k, k % 7, (k * 37) % 180) for k in range(40)] + [(99, 5, 5), (100, 10**6, 10**6), (101, 1, 10**6)], "pair_id long, origin long, node long")
    want = {r.pair_id: (round(r.cost, 6), r.path) for r in search.routes(edges, pairs).collect()}
    monkeypatch.setattr(search, "MOST_BROADCAST_EDGES", 0)
    assert {r.pair_id: (round(r.cost, 6), r.path) for r in search.routes(edges, pairs).collect()} == want and want[99] == (0.0, [5]) and want[100] == (0.0, [10**6]) and 101 not in want
