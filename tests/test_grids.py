"""Grids of a budget, their cells, and whole edge costs."""

import math

from pyspark.sql import functions as F

from terrapace.functions.profiles import profiles
from terrapace.operators import costs, grids

BOX = "k int, west double, south double, east double, north double"


def test_grids_fit_their_budget(spark):
    boxes = [(1, 27.0, 38.0, 27.01, 38.01), (2, 27.0, 38.0, 28.0, 39.0), (3, 27.0, 38.0, 27.0, 38.0), (4, 0.0, -90.0, 0.0, 90.0), (5, 28.0, 39.0, 27.0, 38.0)]
    got = {r.k: r for r in grids.plans(spark.createDataFrame(boxes, BOX)).collect()}
    assert (got[1].width, got[1].height, got[1].coarsened) == (36, 36, False)  # a hundredth of a degree in cells of an arc second
    assert got[2].points <= 25_000 and got[2].coarsened and got[2].width * got[2].res_deg >= 1.0
    assert (got[3].width, got[3].height) == (8, 8)
    assert got[4].width == 8 and got[4].points <= 25_000 and got[4].height * got[4].res_deg >= 180.0
    assert (got[5].west, got[5].points) == (27.0, got[2].points)
    least = grids.plans(spark.createDataFrame(boxes[3:4], BOX), 0.00001, 1).first()
    assert least.points == 64
    assert math.isclose(got[1].res_m, got[1].res_deg * 111_320 * math.sqrt(math.cos(math.radians(38.005))))
    assert grids.plans(spark.createDataFrame([], BOX)).count() == 0


def test_cells_run_from_the_north_and_stay_near_their_own_route(spark):
    plan = grids.plans(spark.createDataFrame([(1, 27.0, 38.0, 27.0039, 38.0039), (2, 27.0, 38.0, 27.0039, 38.0039)], BOX), 0.0005)
    cells = grids.cells(plan, "k")
    assert cells.count() == 128
    first = cells.where("k = 1 and row = 0 and col = 0").first()
    assert math.isclose(first.lat, 38.00375) and math.isclose(first.lon, 27.00025)
    line = spark.createDataFrame([(1, 27.0, 38.00375, 27.004, 38.00375), (2, 27.0, 38.00025, 27.001, 38.00025)], "route_id int, lon double, lat double, lon2 double, lat2 double")
    kept = {(r.k, r.row, r.col) for r in grids.in_corridor(cells, "k", line, 20.0).collect()}
    assert kept == {(1, 0, c) for c in range(8)} | {(2, 7, 0), (2, 7, 1)}


def test_extents_skip_points_without_a_place(spark):
    points = spark.createDataFrame([(1, 27.0, 38.0), (1, None, 38.0), (1, float("nan"), 50.0), (2, None, None)], "k int, lon double, lat double")
    box = grids.extents(points, "k", 111.32).collect()
    assert len(box) == 1 and math.isclose(box[0].north, 38.001) and box[0].east - 27.0 > 0.001


def _edge(spark, **other):
    tags = dict.fromkeys((*costs.TAGS, "sidewalk"), F.lit(None).cast("string")) | dict.fromkeys(costs.FLAGS, F.lit(None).cast("boolean"))
    measures = dict(length_m=F.lit(100.0), slope_pct=F.lit(0.0), steps=F.lit(False), quality=F.lit(1.0), rank=F.lit(4), limit_kmh=F.lit(None).cast("double"), lst=F.lit(None).cast("double"), green=F.lit(None).cast("double"))
    return spark.range(1).select(F.lit(1).alias("u"), F.lit(2).alias("v"), *((F.lit(other[a]) if a in other else x).alias(a) for a, x in (tags | measures).items()))


def test_whole_costs_of_one_edge(spark):
    some = profiles(spark).where("profile in ('adult', 'night_walk', 'bicycle', 'car')")
    night = spark.createDataFrame([(True, 0.0)], "night boolean, sun double")
    by = lambda edges, **k: {r.profile: r for r in costs.evaluated(edges, some, **k).collect()}
    plain = by(_edge(spark))
    assert all(r.status == "ok" and r.reason == "" for r in plain.values()) and math.isclose(plain["adult"].cost, 100.0)
    dark = by(_edge(spark, lit="no", sidewalk="none", rank=3), when=night)
    assert math.isclose(dark["adult"].cost, 120.0 * 1.6 * 1.3) and math.isclose(dark["night_walk"].cost, 100.0 * 2.0 * 1.3)
    assert math.isclose(by(_edge(spark), extra=F.array(F.lit(0.5), F.lit(None).cast("double")), extra_weight=0.3)["adult"].cost, 115.0)
    steps = by(_edge(spark, highway="steps", steps=True))
    assert steps["car"].status == "access" and steps["car"].cost is None and steps["adult"].status == "ok"
    steep = by(_edge(spark, slope_pct=-40.0))
    assert (steep["car"].status, steep["car"].reason) == ("profile", "")
    reached = spark.createDataFrame([("car", 1), ("adult", 9)], "profile string, node long")
    closed = costs.block_reasons(costs.evaluated(_edge(spark, highway="steps"), some), reached).collect()
    assert [(r.profile, r.status, r.edges) for r in closed] == [("car", "access", 1)]


def test_time_without_nodes_and_the_nearest_place(spark):
    assert costs.time_context(spark.createDataFrame([], "lat double"), 12.0, 172).first().night is None
    unknown = spark.createDataFrame([(None, None)], "night boolean, sun double")
    adult = profiles(spark).where("profile = 'adult'")
    assert costs.evaluated(_edge(spark, lit="no", lst=1.0), adult, unknown).first().cost == costs.evaluated(_edge(spark, lit="no", lst=1.0), adult).first().cost
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 2, 2.0), (3, 2, 1.0), (5, 6, None)], "u long, v long, cost double")
    got = {r.node: r.cost for r in costs.from_nearest(edges, spark.createDataFrame([(0,), (3,), (3,)], "node long")).collect()}
    assert got == {0: 0.0, 1: 2.0, 2: 1.0, 3: 0.0}
    assert costs.from_nearest(edges, spark.createDataFrame([], "node long")).count() == 0


def test_exploded_cells_are_not_broadcast(spark):
    boxes = spark.createDataFrame([(1, 27.0, 38.0, 27.01, 38.01)], "k long, west double, south double, east double, north double")
    segments = spark.createDataFrame([(1, 27.001, 38.001, 27.009, 38.009), (1, 27.001, 38.009, 27.009, 38.001)], "route_id long, lon double, lat double, lon2 double, lat2 double")
    cells = grids.cells(grids.plans(boxes, 0.0001, 5000), "k")
    kept = grids.in_corridor(cells, "k", segments, 30.0)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "LeftSemi" in plan
    assert kept.columns == cells.columns and kept.count() == kept.distinct().count() > 0


def test_the_first_size_that_fits_is_taken(spark):
    boxes = [(k, 27.0, 38.0, 27.0 + 0.37 * k, 38.0 + 0.0011 * k * k) for k in range(1, 30)] + [(30, 0.0, 0.0, 20000.0, 0.0)]  # the last takes over 1,400 steps
    cells = lambda side, res: max(8, math.ceil(side / res))
    for r in grids.plans(spark.createDataFrame(boxes, BOX), 0.0003, 64).collect():
        lon, lat = max(1e-9, r.east - r.west), max(1e-9, r.north - r.south)
        first = math.sqrt(lon * lat / 64) if (lon / 0.0003) * (lat / 0.0003) > 64 else 0.0003
        sizes = [first] + [first * math.pow(1.01, k) for k in range(1, 2048)]
        want = next(x for x in sizes if cells(lon, x) * cells(lat, x) <= 64)
        assert math.isclose(r.res_deg, want, rel_tol=1e-9)
