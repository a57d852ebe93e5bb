"""Plans and edge cases of operators that the comparison with SQL does not show."""

import pytest

from terrapace.operators import cues, network as net, running, search, terrain
from terrapace.plans import network, registry
from terrapace.sources.fixtures import view

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["g01_directed_edges", "a06_node_degree"])
def test_no_product_of_nodes(spark, name):
    plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    products = [line for line in plan.splitlines() if "NestedLoopJoin" in line or "CartesianProduct" in line]
    assert "HashJoin" in plan or "SortMergeJoin" in plan
    assert all("node_id" not in line for line in products)


def test_running_totals_of_tied_values(spark):
    rows = [(0.0, k) for k in range(300)] + [(float(k), k) for k in range(300, 340)]
    got = running.running_totals(spark.createDataFrame(rows, "x double, k long").repartition(5), ["x", "k"], {"n": "1L"}, parts=8)
    assert sorted((r.k, r.n) for r in got.collect()) == [(k, k + 1) for k in range(340)]
    assert got.sparkSession.createDataFrame(rows, "x double, k long").select(running._range(spark.createDataFrame(rows, "x double, k long"), ["x", "k"], 8)).distinct().count() > 4


def test_large_graphs_are_refused(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, None)], "u long, v long, cost double")
    monkeypatch.setattr(search, "MOST_BROADCAST_EDGES", 1)
    with pytest.raises(ValueError, match="can't be broadcast"):
        search.csr(edges)
    found = search.shortest_paths(edges, spark.createDataFrame([(1,)], "origin long"))
    assert {(r.node, r.cost) for r in found.collect()} == {(1, 0.0), (2, 1.0), (3, 2.0)}


def test_gaps_are_filled_ring_by_ring(spark):
    line = spark.createDataFrame([(i, 0, 10.0 if i == 0 else 40.0 if i == 4 else None) for i in range(5)], "i long, j long, value double")
    assert terrain.filled(line).count() == 0  # too little is known
    assert {r.i: r.value for r in terrain.filled(line, 0.3).collect()} == {0: 10.0, 1: 10.0, 2: 25.0, 3: 40.0, 4: 40.0}
    assert terrain.filled(line.limit(0)).count() == 0


def test_cues_say_what_to_do(spark):
    points = [(1, 1, 27.0, 38.0, 0.0), (1, 2, 27.001, 38.0, 60.0), (1, 3, 27.001, 38.001, 60.0), (2, 1, 27.0, 38.0, 0.0)]
    rows = cues.cue_sheet(spark.createDataFrame(points, "route_id long, seq int, lon double, lat double, z double")).orderBy("step").collect()
    assert [(r.route_id, r.direction) for r in rows] == [(1, "depart"), (1, "left"), (1, "arrive")]
    assert rows[1].instruction.startswith("Turn left along path for 88m (+60.0m") and rows[1].warning.startswith("Steep: 68") and rows[2].before_m == rows[1].distance_m


def test_batch_pairs_by_place(spark):
    """Costs of g12 are those of single searches between the n-th zone and the n-th facility."""
    got = {r.pair_id: r.cost for r in registry.QUERIES["g12_batch_routes"](spark, DIR).collect()}
    zones = sorted((r.zone_id, r.node_id) for r in network._snapped(spark, DIR, "zones", "zone_id").collect())
    stops = sorted((r.facility_id, r.node_id) for r in network._snapped(spark, DIR, "facilities", "facility_id").collect())
    ids = [sorted(r[0] for r in view(spark, DIR, name).select(key).collect()) for name, key in (("zones", "zone_id"), ("facilities", "facility_id"))]
    zones, stops = dict(zones), dict(stops)
    asked = {n: (zones.get(a), stops.get(b)) for n, (a, b) in enumerate(zip(*ids), 1) if zones.get(a) is not None and stops.get(b) is not None}
    origins = spark.createDataFrame([(o,) for o in {a for a, _ in asked.values()}], "origin long")
    costs = {(r.origin, r.node): r.cost for r in search.shortest_paths(network._costed(spark, DIR, "adult", False), origins).collect()}
    assert got and got == {n: pytest.approx(costs[p], abs=1e-3) for n, p in asked.items() if p in costs}


def test_medians_by_position(spark):
    for values in ([], [4.0], [1.0, 9.0], [5.0, 1.0, 3.0], [2.0] * 7 + [10.0, 0.0, 6.0]):
        frame = spark.createDataFrame([(x, k) for k, x in enumerate(values)], "x double, k long")
        numbered = running.running_totals(frame, ["x", "k"], {"n": "1L"}, parts=1) if values else frame.selectExpr("x", "k", "k as n")
        want = sorted(values)
        assert running.median(numbered, "x", "n").first()[0] == ((want[(len(want) - 1) // 2] + want[len(want) // 2]) / 2 if values else None)


def test_heights_are_filled_ring_by_ring_and_stored_once(spark):
    nodes = spark.createDataFrame([(k, 10.0 if k == 0 else 30.0 if k == 4 else None) for k in range(7)] + [(50, None)], "node long, z double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (1, 2)], "u long, v long")
    got = {r.node: r.z for r in net.fill_heights(nodes, edges).collect()}
    assert got == {0: 10.0, 1: 10.0, 2: pytest.approx((10.0 + 10.0 + 30.0) / 3), 3: 30.0, 4: 30.0, 5: 30.0, 6: 30.0, 50: 0.0}
