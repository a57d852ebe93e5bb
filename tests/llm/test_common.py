"""Components and joins with heavy nodes."""

from terrapace.llm import common


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_EDGES", 3)
    edges = [(0, k) for k in range(1, 30)] + [(100, k) for k in range(101, 120)] + [(29, 100), (200, 201), (201, 202), (5, 5)]
    got = common.components(spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in edges], "a long, b long"))
    want = {k: 0 for k in [*range(30), *range(100, 120)]} | {k: 200 for k in (200, 201, 202)}
    assert {r.node: r.component for r in got.collect()} == want and got.count() == len(want)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_heavy_keys_lose_no_row(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(200)], "g long, x long")
    table = common.stored(rows.groupBy("g").agg({"x": "count"}).toDF("g", "n").selectExpr("g", "n", "g * 10 as y"), "table")
    plain = sorted(map(tuple, common.join_heavy(rows, table, "g", "n").select("g", "x", "y").collect()))
    monkeypatch.setattr(common, "HEAVY_EDGES", 50)
    assert sorted(map(tuple, common.join_heavy(rows, table, "g", "n").select("g", "x", "y").collect())) == plain and len(plain) == 200
