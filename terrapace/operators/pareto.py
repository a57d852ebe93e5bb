"""Pareto search: all routes between two places that no other one beats in every objective.

A fixpoint over sets of labels: every round extends the labels that survived the last one by an edge, and one aggregation by (query, node)
drops what is dominated there. Labels are vectors of whole numbers, so that equal routes are equal however they were added up. Bounds
from reverse searches, which end where every way is worse than a known one, say what the rest of the way costs at least in each objective; labels that with it are no better than a
route already found go no further. Frontiers have no limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import Rounds, ancestors
from .network import stored
from .search import routes, shortest_paths

OBJECTIVES = ("time_s", "ascent_m", "heat", "kcal")
#: Labels count thousandths of an objective's unit.
UNITS = 1000


def whole(objectives: tuple[str, ...] = OBJECTIVES) -> list:
    """The objectives as whole numbers of thousandths."""
    return [F.round(F.col(c) * UNITS).cast("long").alias(c) for c in objectives]


def first_ways(edges: DataFrame, queries: DataFrame, objectives: tuple[str, ...] = OBJECTIVES) -> DataFrame:
    """(query, goal, seed_<objective> ...): the cost vector of one way for each of queries(query, origin, goal), the least in the first objective; no row where there is no way."""
    one = edges.groupBy("u", "v").agg(F.min(F.struct(*objectives)).alias("x")).select("u", "v", "x.*")
    pairs = queries.select(F.col("query").cast("long").alias("pair_id"), "origin", F.col("goal").alias("node"))
    found = stored(routes(one.select("u", "v", F.col(objectives[0]).cast("double").alias("cost")), pairs), "first")
    ends = F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("u"), F.expr("slice(path, 2, size(path))").alias("v"))
    steps = found.where("size(path) > 1").select("pair_id", F.inline(ends)).join(one, ["u", "v"]).groupBy("pair_id").agg(*(F.sum(c).alias(c) for c in objectives))
    sums = found.select("pair_id").join(steps, "pair_id", "left").select(F.col("pair_id").alias("query"), *(F.coalesce(c, F.lit(0).cast("long")).alias(f"seed_{c}") for c in objectives))
    return queries.select("query", "goal").join(sums, "query")


def reverse_bounds(edges: DataFrame, goals: DataFrame, objectives: tuple[str, ...] = OBJECTIVES) -> DataFrame:
    """(goal, node, low_<objective> ...): least cost from each node to each of goals(goal), by objective; nodes without a way are not there.

    goals may have a most_<objective> for each: then each search ends there. Nodes that no search reaches are not there, and what a search
    does not reach costs at least 1 more than its limit.
    """
    own = f"most_{objectives[0]}" in goals.columns
    found = []
    for c in objectives:
        back = edges.groupBy(F.col("v").alias("u"), F.col("u").alias("v")).agg(F.min(c).cast("double").alias("cost"))
        starts = goals.select(F.col("goal").alias("origin"), *([F.col(f"most_{c}").cast("double").alias("most")] if own else []))
        found.append(shortest_paths(back, starts).select(F.col("origin").alias("goal"), "node", F.lit(c).alias("of"), F.round("cost").cast("long").alias("low")))
    rows = reduce(lambda a, b: a.union(b), found)
    bounds = rows.groupBy("goal", "node").agg(*(F.min(F.when(F.col("of") == c, F.col("low"))).alias(f"low_{c}") for c in objectives))
    if not own:
        return bounds
    return bounds.join(goals, "goal").select("goal", "node", *(F.coalesce(f"low_{c}", F.col(f"most_{c}") + 1).alias(f"low_{c}") for c in objectives))


def _no_worse(a: str, b: str, names: list[str]) -> str:
    return " and ".join(f"{a}.{c} <= {b}.{c}" for c in names)


def frontier(edges: DataFrame, queries: DataFrame, objectives: tuple[str, ...] = OBJECTIVES) -> tuple[DataFrame, DataFrame]:
    """(solutions, labels) of queries(query, origin, node) over edges(u, v, objectives as whole numbers, none negative).

    solutions(query, label, objectives) are the non-dominated cost vectors at each query's node, one for each vector; labels(tree, node, pred,
    place) is the tree of all labels, for ways(). A query whose ends are one node has the zero vector; one without a way has no row.
    A first way of each query bounds all: a label that with the least rest of its way is worse than it goes no further, so the reverse searches
    end at the vectors of their goal's first ways. Beyond that everything is worse in each objective.
    """
    names = list(objectives)
    edges = stored(edges.select("u", "v", *names), "edges")
    queries = stored(queries.select("query", F.col("origin").cast("long"), F.col("node").cast("long").alias("goal")), "queries")
    seeds = stored(first_ways(edges, queries, objectives), "seeds")
    goals = stored(seeds.groupBy("goal").agg(*(F.max(f"seed_{c}").alias(f"most_{c}") for c in names)), "goals")
    bounds = stored(reverse_bounds(edges, goals, objectives), "bounds").hint("merge")  # never sent through the driver
    label = F.xxhash64("query", "place", *names)
    start = queries.select("query", "goal", F.col("origin").alias("place"), *(F.lit(0).cast("long").alias(c) for c in names))
    start = start.join(bounds.select("goal", F.col("node").alias("place")), ["goal", "place"], "left_semi")
    rounds = Rounds(start.select("query", "goal", "place", *names, label.alias("label"), F.lit(None).cast("long").alias("pred")), "labels")
    front = rounds.last()
    while front.take(1):
        step = front.select("query", "goal", F.col("label").alias("pred"), F.col("place").alias("u"), *(F.col(c).alias(f"g_{c}") for c in names)).join(edges, "u")
        tried = step.groupBy("query", "goal", F.col("v").alias("place"), *((F.col(f"g_{c}") + F.col(c)).alias(c) for c in names)).agg(F.min("pred").alias("pred"))
        known = rounds.all()
        done = known.where("place = goal").groupBy("query").agg(F.collect_list(F.struct(*names)).alias("done"))
        ahead = tried.join(bounds, (tried["goal"] == bounds["goal"]) & (tried["place"] == bounds["node"])).drop(bounds["goal"], bounds["node"]).join(seeds.drop("goal"), "query").join(done, "query", "left")
        worse = f"{' and '.join(f'seed_{c} <= {c} + low_{c}' for c in names)} and ({' or '.join(f'seed_{c} < {c} + low_{c}' for c in names)})"
        beaten = f"exists(done, s -> {' and '.join(f's.{c} <= {c} + low_{c}' for c in names)})"
        ahead = ahead.where(~F.expr(worse) & ~F.coalesce(F.expr(beaten), F.lit(False))).select("query", "goal", "place", *names, "pred")
        here = known.join(ahead.select("query", "place").distinct(), ["query", "place"], "left_semi").select("query", "goal", "place", *names, "pred")
        both = ahead.withColumn("new", F.lit(True)).union(here.withColumn("new", F.lit(False)))
        sets = both.groupBy("query", "goal", "place").agg(F.collect_list(F.struct("new", *names, "pred")).alias("all"))
        # Vectors of a round are unlike, so of equal ones the other is older.
        kept = F.expr(f"filter(all, x -> x.new and not exists(all, y -> {_no_worse('y', 'x', names)} and not ({_no_worse('x', 'y', names)} and y.new)))")
        survivors = sets.select("query", "goal", "place", F.inline(kept))
        front = rounds.add(survivors.withColumn("label", label))
    at_goal = rounds.all().where("place = goal").groupBy("query").agg(F.collect_list(F.struct("label", *names)).alias("all"))
    best = F.expr(f"filter(all, x -> not exists(all, y -> {_no_worse('y', 'x', names)} and not ({_no_worse('x', 'y', names)})))")
    return at_goal.select("query", F.inline(best)), rounds.all().select(F.col("query").alias("tree"), F.col("label").alias("node"), "pred", "place")


def ways(solutions: DataFrame, labels: DataFrame) -> DataFrame:
    """(query, label, path: array of nodes) of frontier()'s solutions."""
    targets = solutions.select(F.struct("query", "label").alias("key"), F.col("query").alias("tree"), F.col("label").alias("node"))
    steps = ancestors(labels.select("tree", "node", "pred"), targets)
    places = steps.join(labels.select(F.col("tree").alias("q"), F.col("node").alias("n"), "place"), (F.col("key.query") == F.col("q")) & (F.col("node") == F.col("n")))
    path = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "place"))), lambda s: s["place"])
    return places.groupBy("key").agg(path.alias("path")).select("key.query", "key.label", "path")


def thinned(solutions: DataFrame, objectives: tuple[str, ...] = OBJECTIVES, eps: float = 0.03) -> DataFrame:
    """Solutions that differ by more than eps: in order of their vectors, one goes if one kept before it is nowhere worse by more than that share."""
    names = list(objectives)
    sets = solutions.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(*names, "label"))).alias("all"))
    beaten = " and ".join(f"k.{c} <= x.{c} * (1 + {eps!r}D)" for c in names)
    kept = F.expr(f"aggregate(all, slice(all, 1, 0), (kept, x) -> if(exists(kept, k -> {beaten}), kept, concat(kept, array(x))))")
    return sets.select("query", F.inline(kept))
