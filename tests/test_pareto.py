"""The Pareto frontier against all simple paths of small graphs."""

import random

import pytest

from terrapace.operators import pareto

NAMES = pareto.OBJECTIVES


def every_path(edges, origin, goal):
    """{cost vector: paths} of all simple paths."""
    found, stack = {}, [(origin, (0,) * 4, (origin,))]
    while stack:
        at, cost, path = stack.pop()
        if at == goal:
            found.setdefault(cost, []).append(list(path))
            continue
        for u, v, *w in edges:
            if u == at and v not in path:
                stack.append((v, tuple(a + b for a, b in zip(cost, w)), (*path, v)))
    return found


def best(costs):
    less = lambda a, b: a != b and all(x <= y for x, y in zip(a, b))
    return {c for c in costs if not any(less(d, c) for d in costs)}


def graph(seed, side=4, most=4):
    rng = random.Random(seed)
    at = lambda i, j: i * side + j
    both = [(at(i, j), at(i + a, j + b)) for i in range(side) for j in range(side) for a, b in ((0, 1), (1, 0)) if i + a < side and j + b < side]
    both += [(b, a) for a, b in both] + [(0, 5)]  # a parallel way
    return [(u, v, rng.randrange(1, most), rng.randrange(most), 0, rng.randrange(most)) for u, v in both]


@pytest.mark.parametrize("seed", [1, 2])
def test_frontier_is_that_of_all_paths(spark, seed):
    edges = graph(seed)
    queries = [(1, 0, 15), (2, 3, 12), (3, 6, 6), (4, 0, 99), (5, 15, 0)]
    solutions, labels = pareto.frontier(spark.createDataFrame(edges, f"u long, v long, {', '.join(f'{c} long' for c in NAMES)}"), spark.createDataFrame(queries, "query long, origin long, node long"))
    rows = solutions.collect()
    paths = {(r.query, r.label): r.path for r in pareto.ways(solutions, labels).collect()}
    for query, origin, goal in queries:
        every = every_path(edges, origin, goal) if goal != 99 else {}
        mine = [r for r in rows if r.query == query]
        assert {tuple(r[c] for c in NAMES) for r in mine} == best(set(every)) and len(mine) == len(best(set(every)))
        for r in mine:  # each solution's way is one that costs just that
            assert paths[query, r.label] in every[tuple(r[c] for c in NAMES)]


def test_thinned_solutions(spark):
    rows = [(1, 10, 100, 100, 0, 0), (1, 11, 102, 99, 0, 0), (1, 12, 200, 50, 0, 0), (1, 13, 300, 49, 0, 0), (2, 14, 0, 0, 0, 0)]
    frame = spark.createDataFrame(rows, f"query long, label long, {', '.join(f'{c} long' for c in NAMES)}")
    assert {r.label for r in pareto.thinned(frame).collect()} == {10, 12, 14}
    assert {r.label for r in pareto.thinned(frame, eps=0.0).collect()} == {10, 11, 12, 13, 14}


def test_no_queries(spark):
    edges = spark.createDataFrame(graph(3), f"u long, v long, {', '.join(f'{c} long' for c in NAMES)}")
    solutions, labels = pareto.frontier(edges, spark.createDataFrame([], "query long, origin long, node long"))
    assert solutions.count() == 0 and pareto.ways(solutions, labels).count() == 0


def test_reverse_searches_end_where_all_is_worse(spark, monkeypatch):
    line = [(a, b, 3, a % 2 + 1, 1, 2) for k in range(200) for a, b in ((k, k + 1), (k + 1, k))] + [(50, 60, 100, 1, 1, 1), (60, 51, 1, 0, 0, 0)]
    edges = spark.createDataFrame(line, f"u long, v long, {', '.join(f'{c} long' for c in NAMES)}")
    sizes, stored = {}, pareto.stored
    monkeypatch.setattr(pareto, "stored", lambda df, name: [kept := stored(df, name), sizes.__setitem__(name, kept.count())][0])
    solutions, _ = pareto.frontier(edges, spark.createDataFrame([(1, 50, 51)], "query long, origin long, node long"))
    assert {tuple(r[c] for c in NAMES) for r in solutions.collect()} == {(3, 1, 1, 2), (101, 1, 1, 1)}
    assert sizes["bounds"] < 20  # of 201 nodes
