"""Searches by blocks against the search over one array, on graphs cut into many blocks."""

import random

import pytest

from terrapace.operators import blocks, search


@pytest.fixture
def graph(spark, monkeypatch):
    rng, side = random.Random(11), 14
    links = [(i + side * j, i + 1 - d + side * (j + d)) for i in range(side) for j in range(side) for d in (0, 1) if i + 1 - d < side and j + d < side]
    rows = [(a, b, rng.uniform(1, 9)) for u, v in links for a, b in ((u, v), (v, u)) if rng.random() < 0.9] + [(500, 501, 1.0)]
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 90)
    monkeypatch.setattr(blocks, "TREES", 2)
    monkeypatch.setattr(blocks, "PAIRS", 3)
    return spark.createDataFrame(rows, "u long, v long, cost double"), rows


def costs(rows, limit=float("inf")):
    return {(r[0], r[1]): round(r[2], 9) for r in rows if r[2] <= limit}


def test_trees_by_blocks(spark, graph, monkeypatch):
    edges, _ = graph
    origins = spark.createDataFrame([(0,), (97,), (195,), (700,)], "origin long")
    want = costs(search.shortest_paths(edges, origins).select("origin", "node", "cost").collect())
    stored, rounds = blocks.stored, []
    monkeypatch.setattr(blocks, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    monkeypatch.setattr(search, "MOST_BROADCAST_EDGES", 0)
    assert costs(search.shortest_paths(edges, origins).select("origin", "node", "cost").collect()) == want
    assert rounds.count("relaxed") < 20  # a round for each node of the longest way would be 26 and more
    near = costs(search.shortest_paths(edges, origins, 20.0).select("origin", "node", "cost").collect())
    assert near == {k: c for k, c in want.items() if c <= 20.0}


def test_routes_by_regions(spark, graph, monkeypatch):
    edges, rows = graph
    rng = random.Random(3)
    pairs = [(k, rng.randrange(196), rng.randrange(196)) for k in range(30)] + [(30, 0, 500), (31, 500, 501), (32, 7, 7), (33, 900, 900), (34, 900, 1), (35, 1, 900)]
    asked = spark.createDataFrame(pairs, "pair_id long, origin long, node long")
    want = {r.pair_id: r.cost for r in search.routes(edges, asked).collect()}
    monkeypatch.setattr(search, "MOST_BROADCAST_EDGES", 0)
    weight = {(u, v): c for u, v, c in rows}
    for most in (blocks.REGION_EDGES, 1):  # the second leaves pairs to whole trees
        monkeypatch.setattr(blocks, "REGION_EDGES", most)
        got = {r.pair_id: r for r in search.routes(edges, asked).collect()}
        assert {k: round(r.cost, 9) for k, r in got.items()} == {k: round(c, 9) for k, c in want.items()}
        for k, r in got.items():
            assert (r.path[0], r.path[-1]) == pairs[k][1:] and abs(sum(weight[s] for s in zip(r.path, r.path[1:])) - r.cost) < 1e-9


def test_dearer_streets_by_regions_and_by_trees(spark, graph, monkeypatch):
    edges, _ = graph
    asked = spark.createDataFrame([(1, 0, 195, [0, 1, 2, 3, 17, 31]), (2, 40, 44, [40, 41, 42, 43, 44, 999])], "pair_id long, origin long, node long, along array<long>")
    want = costs([(1, r.pair_id, r.cost) for r in search.routes(edges, asked, 4.0).collect()])
    monkeypatch.setattr(search, "MOST_BROADCAST_EDGES", 0)
    assert costs([(1, r.pair_id, r.cost) for r in search.routes(edges, asked, 4.0).collect()]) == want
    monkeypatch.setattr(blocks, "REGION_EDGES", 1)
    assert costs([(1, r.pair_id, r.cost) for r in search.routes(edges, asked, 4.0).collect()]) == want


def test_trees_end_at_their_goals(spark, graph):
    edges, _ = graph
    starts, goals = spark.createDataFrame([(0, 0), (97, 97)], "tree long, node long"), spark.createDataFrame([(0, 0), (0, 15), (97, 98)], "tree long, node long")
    whole = {(r.tree, r.node): r.cost for r in blocks.trees(edges, starts).collect()}
    near = {(r.tree, r.node): r.cost for r in blocks.trees(edges, starts, goals=goals).collect()}
    assert len(near) < len(whole)
    for tree, node in ((0, 0), (0, 15), (97, 98)):
        assert near[tree, node] == whole[tree, node]
