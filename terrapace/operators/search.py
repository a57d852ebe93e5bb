"""Shortest paths as Spark tasks: origins are dealt out, the graph travels as compressed arrays.

The graph is broadcast once as CSR arrays (about 20 bytes an edge), behind a check of its size; each task runs
a search for every origin of its batches. A graph beyond the limit is searched by blocks
instead.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bearing_change
from ..functions.impedance import turn_seconds
from . import blocks
from .fixpoint import ancestors
from .network import stored

#: Directed edges whose arrays are broadcast (about 70 bytes each as lists, in every worker); above that, searches are joins.
MOST_BROADCAST_EDGES = 2_000_000

TREE = "origin long, node long, cost double, pred long"


def csr(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node ids, row starts, targets, costs) of edges(u, v, cost); edges of null cost can't be passed. More than MOST_BROADCAST_EDGES fail."""
    edges = stored(edges.where("cost is not null").select("u", "v", F.col("cost").cast("double")), "edges")
    if edges.count() > MOST_BROADCAST_EDGES:
        raise ValueError(f"a graph of more than {MOST_BROADCAST_EDGES} edges can't be broadcast: cut it, or use relaxed_paths()")
    rows = edges.toPandas()
    u, v, cost = rows["u"].to_numpy(np.int64), rows["v"].to_numpy(np.int64), rows["cost"].to_numpy(np.float64)
    ids = np.unique(np.concatenate((u, v)))
    u, v = np.searchsorted(ids, u), np.searchsorted(ids, v)
    order = np.lexsort((v, u))
    starts = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(np.bincount(u, minlength=len(ids)), out=starts[1:])
    return ids, starts, v[order].astype(np.int32), cost[order]


def search(starts: list, targets: list, costs: list, origin: int, limit: float, goals: set | None = None, dear: set | None = None, factor: float = 1.0) -> tuple[dict, dict]:
    """Settled costs and predecessors of one origin; ends at the limit or when all goals are settled. Edges of dear, as (u, v), cost factor times more."""
    best, pred, done, heap = {origin: 0.0}, {origin: -1}, {}, [(0.0, origin)]
    left = set(goals) if goals is not None else None
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done[u] = d
        if left is not None:
            left.discard(u)
            if not left:
                break
        for k in range(starts[u], starts[u + 1]):
            v = targets[k]
            to = d + (costs[k] * factor if dear and (u, v) in dear else costs[k])
            if to <= limit and to < best.get(v, float("inf")):
                best[v], pred[v] = to, u
                heapq.heappush(heap, (to, v))
    return done, pred


def shortest_paths(edges: DataFrame, origins: DataFrame, limit: float = float("inf"), goals: DataFrame | None = None) -> DataFrame:
    """(origin, node, cost, pred) for all nodes within limit of origins(origin), or of the goals(node) only. Origins may have a limit of their own, `most`."""
    origins = origins.groupBy(F.col("origin").cast("long").alias("origin")).agg(F.max("most" if "most" in origins.columns else F.lit(float(limit))).alias("most"))
    edges = stored(edges.select("u", "v", "cost"), "edges")
    if edges.count() > MOST_BROADCAST_EDGES:
        return relaxed_paths(edges, origins) if goals is None else relaxed_paths(edges, origins).join(goals, "node", "left_semi").select("origin", "node", "cost", "pred")
    spark = edges.sparkSession
    ids, starts, targets, costs = csr(edges)
    wanted = goal_ids = None
    if goals is not None:
        goal_ids = {r[0] for r in goals.distinct().collect()}  # nodes of a graph that is broadcast anyway
        wanted = {k for k, i in enumerate(ids.tolist()) if i in goal_ids}
    shared = spark.sparkContext.broadcast((ids, starts, targets, costs))

    def run(frames):
        ids, starts, targets, costs = shared.value
        lists = starts.tolist(), targets.tolist(), costs.tolist()
        for frame in frames:
            for origin, most in zip(frame["origin"].tolist(), frame["most"].tolist()):
                at = int(np.searchsorted(ids, origin))
                if at >= len(ids) or ids[at] != origin:  # a node without edges reaches itself
                    if goal_ids is None or origin in goal_ids:
                        yield pd.DataFrame({"origin": [origin], "node": [origin], "cost": [0.0], "pred": [-1]})
                    continue
                done, pred = search(*lists, at, most, wanted)
                picked = [n for n in done if wanted is None or n in wanted]
                yield pd.DataFrame({"origin": origin, "node": ids[picked], "cost": [done[n] for n in picked], "pred": [int(ids[pred[n]]) if pred[n] >= 0 else -1 for n in picked]})

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return origins.repartition(n).mapInPandas(run, TREE)  # dealt evenly, not by hash


def relaxed_paths(edges: DataFrame, origins: DataFrame, limit: float = float("inf")) -> DataFrame:
    """The same by joins, for graphs of any size."""
    own = ["most"] if "most" in origins.columns else []
    starts = origins.select("origin", *own).distinct().select(F.col("origin").alias("tree"), F.col("origin").alias("node"), *own)
    return relaxed_trees(edges, starts, limit).withColumnRenamed("tree", "origin")


def relaxed_trees(edges: DataFrame, starts: DataFrame, limit: float = float("inf"), dear: DataFrame | None = None, factor: float = 1.0, rounds: int = 100_000, goals: DataFrame | None = None) -> DataFrame:
    """(tree, node, cost, pred) of the search from each of starts(tree, node), whole or as far as goals(tree, node): by blocks of the graph, as blocks.trees().

    Edges of dear(tree, u, v) cost factor times more in their tree; infinite: they are shut. Starts may have a limit of their own, `most`.
    """
    return blocks.trees(edges, starts, limit, dear, factor, rounds, goals)


def _dear(pairs: DataFrame) -> DataFrame:
    """(tree, u, v): the streets along each pair's path, both ways."""
    steps = pairs.select(F.col("pair_id").alias("tree"), F.explode(F.arrays_zip(F.slice("along", 1, F.greatest(F.lit(0), F.size("along") - 1)).alias("u"), F.expr("slice(along, 2, size(along))").alias("v"))).alias("s")).select("tree", "s.*").where("u is not null and v is not null")
    return steps.union(steps.select("tree", "v", "u")).distinct()


def _routes_of_any_graph(edges: DataFrame, pairs: DataFrame, factor: float) -> DataFrame:
    """Routes that stay around their origins by regions; the others by whole trees."""
    found, rest = blocks.routes(edges, pairs, factor)
    return found.union(_routes_by_trees(edges, rest, factor)) if rest.take(1) else found


def _routes_by_trees(edges: DataFrame, pairs: DataFrame, factor: float) -> DataFrame:
    own = "along" in pairs.columns
    pairs = pairs.withColumn("tree", F.col("pair_id" if own else "origin"))
    starts, goals = pairs.select("tree", F.col("origin").alias("node")).distinct(), stored(pairs.select("tree", "node").distinct(), "goals")
    tree = relaxed_trees(edges, starts, dear=stored(_dear(pairs), "dear") if own else None, factor=factor, goals=goals)
    reached = pairs.join(tree.select("tree", "node", "cost"), ["tree", "node"])
    parents = tree.select("tree", "node", F.when(F.col("pred") >= 0, F.col("pred")).alias("pred"))
    steps = ancestors(parents, reached.select(F.col("pair_id").alias("key"), "tree", "node"))
    path = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "node"))), lambda x: x["node"])
    paths = steps.groupBy("key").agg(path.alias("path"))
    return reached.join(paths, reached["pair_id"] == paths["key"]).select("pair_id", "cost", "path")


def routes(edges: DataFrame, pairs: DataFrame, factor: float = 1.0) -> DataFrame:
    """(pair_id, cost, path: array of nodes) for pairs(pair_id, origin, node); none where there is no way.

    Pairs of one origin share a search. Where pairs have `along`, an array of nodes, each has a search of its own, in which the streets between
    consecutive nodes of it cost factor times more, either way (infinite: they are shut). Nodes that end no edge are reached from themselves only. A graph
    beyond MOST_BROADCAST_EDGES is searched by joins, and its paths are read off the tree of predecessors by pointer doubling.
    """
    spark = edges.sparkSession
    edges = stored(edges.where("cost is not null").select("u", "v", F.col("cost").cast("double")), "edges")
    own = "along" in pairs.columns
    pairs = pairs.select("pair_id", F.col("origin").cast("long"), F.col("node").cast("long"), *(["along"] if own else []))
    if edges.count() > MOST_BROADCAST_EDGES:
        return _routes_of_any_graph(edges, stored(pairs, "pairs"), factor)
    ids, starts, targets, costs = csr(edges)
    shared = spark.sparkContext.broadcast((ids, starts, targets, costs))

    def run(frames):
        ids, starts, targets, costs = shared.value
        lists = starts.tolist(), targets.tolist(), costs.tolist()
        place = lambda x: int(np.searchsorted(ids, x))
        known = lambda x: place(x) < len(ids) and ids[place(x)] == x
        for frame in frames:
            out = []
            for (origin, _), group in frame.groupby(["origin", "pair_id" if own else "origin"]) if own else (((o, None), g) for o, g in frame.groupby("origin")):
                if not known(origin):
                    out += [(pair, 0.0, [origin]) for pair, node in zip(group["pair_id"].tolist(), group["node"].tolist()) if node == origin]
                    continue
                goals = {place(x) for x in group["node"].tolist() if known(x)}
                dear = None
                if own:
                    along = [place(x) for x in group["along"].iloc[0] if known(x)]
                    dear = {e for a, b in zip(along, along[1:]) for e in ((a, b), (b, a))}
                done, pred = search(*lists, place(origin), float("inf"), goals, dear, factor)
                for pair, node in zip(group["pair_id"].tolist(), group["node"].tolist()):
                    at = place(node) if known(node) else -1
                    if done.get(at, float("inf")) < float("inf"):
                        path, k = [], at
                        while k >= 0:
                            path.append(int(ids[k]))
                            k = pred[k]
                        out.append((pair, done[at], path[::-1]))
            yield pd.DataFrame(out, columns=["pair_id", "cost", "path"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.repartition(n, "pair_id" if own else "origin").sortWithinPartitions("origin")
    return dealt.mapInPandas(run, "pair_id long, cost double, path array<long>")


def path_points(routes: DataFrame, places: DataFrame) -> DataFrame:
    """(route_id, seq, lon, lat, z) of the nodes of routes(); places(node, lon, lat, z)."""
    steps = routes.select(F.col("pair_id").alias("route_id"), F.posexplode("path").alias("at", "node"))
    return steps.join(places, "node").select("route_id", (F.col("at") + 1).alias("seq"), "lon", "lat", "z")


def turn_graph(edges: DataFrame, places: DataFrame, degrees: DataFrame, model: DataFrame, base_ms: float) -> DataFrame:
    """Steps (u, v, cost) between directed edges, so that a search over them knows the edge it came by.

    edges(u, v, cost), one for each pair of nodes; places(node, lon, lat); degrees(u, degree); model: one row of
    turn_models(). A turn's seconds weigh base_ms metres each; turns without seconds are forbidden. Edges are
    named by edge_name(); the step out of origin o starts at -1 - o.
    """
    edges = edges.where("cost is not null")
    at = lambda side: places.select(F.col("node").alias(side), F.col("lon").alias(f"lon_{side}"), F.col("lat").alias(f"lat_{side}"))
    first = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    pairs = first.join(edges.select(F.col("u").alias("b"), F.col("v").alias("c"), "cost"), "b").join(at("a"), "a").join(at("b"), "b").join(at("c"), "c").join(degrees.select(F.col("u").alias("b"), "degree"), "b")
    turn = bearing_change("lon_a", "lat_a", "lon_b", "lat_b", "lon_c", "lat_c")
    pairs = pairs.withColumn("turn", turn).crossJoin(F.broadcast(model))  # one row
    delay = turn_seconds("turn", F.col("degree") >= 3, F.col("degree") == 1)
    steps = pairs.select(edge_name("a", "b").alias("u"), edge_name("b", "c").alias("v"), (F.col("cost") + delay * base_ms).alias("cost")).where("cost is not null")
    return steps.union(edges.select((-1 - F.col("u")).alias("u"), edge_name("u", "v").alias("v"), "cost"))


def edge_name(u: str, v: str):
    """One number for a pair of node ids below 2**31."""
    return F.col(u) * F.lit(1 << 31) + F.col(v)


def turn_paths(steps: DataFrame, origins: DataFrame, limit: float = float("inf")) -> DataFrame:
    """(origin, node, cost): least costs with turns over the steps of turn_graph()."""
    found = shortest_paths(steps, origins.select((-1 - F.col("origin")).alias("origin")), limit)
    to = F.when(F.col("node") < 0, -1 - F.col("node")).otherwise(F.col("node") % (1 << 31))
    return found.select((-1 - F.col("origin")).alias("origin"), to.alias("node"), "cost").groupBy("origin", "node").agg(F.min("cost").alias("cost"))
