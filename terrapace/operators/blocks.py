"""Searches on graphs of any size, by blocks: a task holds the streets of one range of node ids and searches it whole, Spark carries what crosses between ranges.

Ranges come from quantiles of the ids, so results don't depend on how ids lie on the ground; the number of rounds does. No task holds more than a block or a region.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixpoint import Rounds
from .network import drop_stored, stored

#: Directed edges of a block, about; trees that a task searches in it together; pairs that share a region; edges of a region at most.
BLOCK_EDGES, TREES, PAIRS, REGION_EDGES = 500_000, 16, 128, 1_500_000

LABEL = "tree long, node long, cost double, pred long, most double, inner boolean"


def cuts_of(edges: DataFrame, count: int) -> list[int]:
    """Ids that end the half-blocks of edges(u, ...)."""
    halves = 2 * max(1, -(-count // BLOCK_EDGES))
    return sorted({int(c) for c in edges.approxQuantile("u", [k / halves for k in range(1, halves)], 0.0005)})


def half_of(node: str | Column, cuts: list[int]) -> Column:
    node = F.col(node) if isinstance(node, str) else node
    at = F.lit(0)
    for c in cuts:
        at = at + (node > c).cast("int")
    return at


def _lists(e: pd.DataFrame, more: np.ndarray):
    """(ids, row starts, targets, costs) of edges and of nodes that may have none; ids of edges' ends that start no edge among these have empty rows."""
    u, v, w = e["u"].to_numpy(np.int64), e["v"].to_numpy(np.int64), e["w"].to_numpy(np.float64)
    ids = np.unique(np.concatenate((u, v, more)))
    a, b = np.searchsorted(ids, u), np.searchsorted(ids, v)
    order = np.argsort(a, kind="stable")
    starts = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(np.bincount(a, minlength=len(ids)), out=starts[1:])
    return ids, starts.tolist(), b[order].tolist(), w[order].tolist()


def _relax(cuts: np.ndarray, parity: int, factor: float):
    """Rows of one block and its trees: kind 0, a known label; 1, a better one to go on from; 2, a dear edge (node, pred)."""

    def run(key, rows: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids, starts, targets, costs = _lists(e, rows["node"].to_numpy(np.int64))
        mine = ((np.searchsorted(cuts, ids, side="left") + parity) // 2 == key[0]).tolist()
        out = []
        for tree, group in rows.groupby("tree"):
            kind = group["kind"].to_numpy()
            at, cost, pred = np.searchsorted(ids, group["node"].to_numpy(np.int64)), group["cost"].to_numpy(), group["pred"].to_numpy(np.int64)
            best, came, heap = [float("inf")] * len(ids), {}, []
            for k, d in zip(at[kind == 0].tolist(), cost[kind == 0].tolist()):
                best[k] = min(best[k], d)
            for k, d, p in zip(at[kind == 1].tolist(), cost[kind == 1].tolist(), pred[kind == 1].tolist()):
                if d < best[k]:
                    best[k], came[k] = d, p
                    heapq.heappush(heap, (d, k))
            if not heap:
                continue
            most = float(group["most"].max())
            dear = set()
            if (kind == 2).any():
                other = np.searchsorted(ids, pred[kind == 2])
                known = ids[np.minimum(other, len(ids) - 1)] == pred[kind == 2]
                dear = set(zip(at[kind == 2][known].tolist(), other[known].tolist()))
            names = ids.tolist()
            while heap:
                d, u = heapq.heappop(heap)
                if d > best[u]:
                    continue
                for j in range(starts[u], starts[u + 1]):
                    v = targets[j]
                    to = d + (costs[j] * factor if dear and (u, v) in dear else costs[j])
                    if to <= most and to < best[v]:
                        best[v], came[v] = to, names[u]
                        if mine[v]:
                            heapq.heappush(heap, (to, v))
            k = np.fromiter(came, dtype=np.int64, count=len(came))
            out.append(pd.DataFrame({"tree": tree, "node": ids[k], "cost": [best[x] for x in came], "pred": list(came.values()), "most": most, "inner": [mine[x] for x in came]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"tree": [], "node": [], "cost": [], "pred": [], "most": [], "inner": []})

    return run


def _between(labels: DataFrame, cuts: list[int], first: int, last: int) -> DataFrame:
    """Labels of the half-blocks from first to last, by plain bounds on ids: files without such ids are skipped."""
    if first > 0:
        labels = labels.where(F.col("node") > cuts[first - 1])
    return labels.where(F.col("node") <= cuts[last]) if last < len(cuts) else labels


def trees(edges: DataFrame, starts: DataFrame, limit: float = float("inf"), dear: DataFrame | None = None, factor: float = 1.0, rounds: int = 100_000, goals: DataFrame | None = None) -> DataFrame:
    """(tree, node, cost, pred) of the search from each of starts(tree, node[, most]) over edges(u, v, cost); edges of dear(tree, u, v) cost factor times more.

    With goals(tree, node), labels that cost as much as all goals of their tree go no further, so what is nearer than the farthest goal is exact and the rest may be missing.

    A round searches, in every block that better labels entered, as far as they lead; labels that leave it enter the next round's blocks, which are
    shifted by half a block, so a way along a border lies inside one. The rounds grow with the blocks that a way crosses, not with its nodes.
    """
    edges = stored(edges.where("cost is not null and cost < double('infinity')").groupBy("u", "v").agg(F.min("cost").alias("w")), "edges")
    cuts = cuts_of(edges, edges.count())
    edges = stored(edges.withColumn("half", half_of("u", cuts)), "halves")
    sorted_cuts = np.array(cuts, dtype=np.int64)
    many = starts.select("tree").distinct().count()
    batches = max(1, -(-many // TREES), min(many, edges.sparkSession.sparkContext.defaultParallelism))
    batch = F.pmod(F.xxhash64("tree"), F.lit(batches)).cast("int")
    most = F.col("most").cast("double") if "most" in starts.columns else F.lit(float(limit))
    front = stored(starts.select("tree", "node", F.lit(0.0).alias("cost"), F.lit(-1).cast("long").alias("pred"), most.alias("most")).where("most >= 0").withColumn("half", half_of("node", cuts)), "front")
    found = None
    for turn in range(rounds):
        block = F.floor((F.col("half") + turn % 2) / 2).cast("int")
        active = front.select(block.alias("block"), batch.alias("batch")).distinct()
        live = [r[0] for r in active.select("block").distinct().collect()]  # numbers of blocks
        if not live:
            break
        rows = front.select(block.alias("block"), batch.alias("batch"), "tree", "node", "cost", "pred", "most", F.lit(1).alias("kind"))
        if found is not None:
            known = _between(found.all(), cuts, 2 * min(live) - turn % 2, 2 * max(live) + 1 - turn % 2).withColumn("half", half_of("node", cuts)).select(block.alias("block"), batch.alias("batch"), "tree", "node", "cost", "pred", "most", F.lit(0).alias("kind"))
            rows = rows.union(known.join(active, ["block", "batch"], "left_semi"))
        if dear is not None:
            shut = dear.withColumn("half", half_of("u", cuts)).select(block.alias("block"), batch.alias("batch"), "tree", F.col("u").alias("node"), F.lit(0.0), F.col("v").alias("pred"), F.lit(float(limit)), F.lit(2))
            rows = rows.union(shut.join(active, ["block", "batch"], "left_semi"))
        streets = edges.withColumn("block", block).where(F.col("block").isin(live)).join(active, "block").select("block", "batch", "u", "v", "w")
        got = stored(rows.groupBy("block", "batch").cogroup(streets.groupBy("block", "batch")).applyInPandas(_relax(sorted_cuts, turn % 2, factor), LABEL), "relaxed")
        mine = got.where("inner").drop("inner")
        found = found or Rounds(mine.limit(0), "trees")
        found.add(mine)
        tried = got.where("not inner").groupBy("tree", "node").agg(F.min(F.struct("cost", "pred", "most")).alias("b")).select("tree", "node", "b.*")
        had = found.all().groupBy("tree", "node").agg(F.min("cost").alias("had"))
        front = stored(tried.join(had, ["tree", "node"], "left").where("had is null or cost < had").drop("had").withColumn("half", half_of("node", cuts)), "front")
        if goals is not None:
            got_to = goals.join(found.all().groupBy("tree", "node").agg(F.min("cost").alias("cost")), ["tree", "node"], "left")
            ends = got_to.groupBy("tree").agg(F.max(F.coalesce("cost", F.lit(float("inf")))).alias("end"))
            front = stored(front.join(ends, "tree", "left").where("end is null or cost < end").drop("end"), "front")
        drop_stored(got)
    else:
        raise RuntimeError("paths did not settle")
    if found is None:
        return starts.select("tree", "node", F.lit(0.0).alias("cost"), F.lit(-1).cast("long").alias("pred")).limit(0)
    best = stored(found.all().groupBy("tree", "node").agg(F.min(F.struct("cost", "pred")).alias("b")).select("tree", "node", "b.cost", "b.pred"), "paths")
    found.drop()
    return best


def _region(low_high: tuple, own: bool, factor: float):
    """Searches of one region's pairs: a row for each pair that the region decides, with null where there is no way."""

    def run(key, pairs: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ends = np.concatenate((pairs["origin"].to_numpy(np.int64), pairs["node"].to_numpy(np.int64)))
        ids, starts, targets, costs = _lists(e, ends)
        cuts, reach = low_high
        half = np.searchsorted(cuts, ids, side="left")
        inside = (np.abs(half - key[0]) <= reach).tolist()
        place = lambda x: int(np.searchsorted(ids, x))
        out = []
        for _, group in pairs.groupby("pair_id" if own else "origin"):
            origin, dear = place(group["origin"].iloc[0]), None
            goals = {place(x) for x in group["node"].tolist()}
            if own:
                along = [place(x) if place(x) < len(ids) and ids[place(x)] == x else -1 for x in group["along"].iloc[0]]
                dear = {s for a, b in zip(along, along[1:]) for s in ((a, b), (b, a))}
            best, pred, done, heap, left, edge = {origin: 0.0}, {origin: -1}, {}, [(0.0, origin)], set(goals), float("inf")
            while heap and left:
                d, u = heapq.heappop(heap)
                if u in done:
                    continue
                if d > edge:  # a way through other regions may be cheaper from here on
                    break
                if not inside[u]:
                    edge = min(edge, d)
                    if u not in left:
                        continue
                done[u] = d
                left.discard(u)
                for j in range(starts[u], starts[u + 1]):
                    v = targets[j]
                    to = d + (costs[j] * factor if dear and (u, v) in dear else costs[j])
                    if to < best.get(v, float("inf")):
                        best[v], pred[v] = to, u
                        heapq.heappush(heap, (to, v))
            open_ = bool(left) and edge < float("inf")
            for pair, node in zip(group["pair_id"].tolist(), group["node"].tolist()):
                at = place(node)
                if at in done:
                    path, k = [], at
                    while k >= 0:
                        path.append(int(ids[k]))
                        k = pred[k]
                    out.append((pair, done[at], path[::-1]))
                elif not open_:
                    out.append((pair, None, None))
        return pd.DataFrame(out, columns=["pair_id", "cost", "path"])

    return run


def routes(edges: DataFrame, pairs: DataFrame, factor: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(found, open): routes of pairs(pair_id, origin, node[, along]) that lie in a region around their origin, and the pairs that no region could decide.

    A region is a block with the half-blocks around it, twice as many each round while it has at most REGION_EDGES. A way counts when it costs
    no more than the cheapest way out of the region; so what is found is exact. found(pair_id, cost, path) has no row where there is no way.
    """
    own = "along" in pairs.columns
    edges = stored(edges.where("cost is not null and cost < double('infinity')").groupBy("u", "v").agg(F.min("cost").alias("w")), "edges")
    count = edges.count()
    cuts = cuts_of(edges, count)
    halves = len(cuts) + 1
    edges = stored(edges.withColumn("half", half_of("u", cuts)), "halves")
    rest = stored(pairs.withColumn("half", half_of("origin", cuts)), "pairs")
    found, reach, last = None, 1, False
    while rest.take(1) and not last and (2 * reach + 1) * count / halves <= max(REGION_EDGES, 3 * count / halves):
        of = "pair_id" if own else "origin"
        many = rest.groupBy("half").agg(F.countDistinct(of).alias("many"))
        dealt = rest.join(many, "half").withColumn("batch", F.pmod(F.xxhash64(of), F.ceil(F.col("many") / PAIRS)).cast("int")).drop("many")
        groups = dealt.select("half", "batch").distinct()
        around = groups.select(F.col("half").alias("centre"), (F.col("batch") + 0).alias("batch"), F.explode(F.sequence(F.col("half") - reach, F.col("half") + reach)).alias("half"))
        streets = edges.join(around, "half").select(F.col("centre").alias("half"), "batch", "u", "v", "w")
        got = stored(dealt.groupBy("half", "batch").cogroup(streets.groupBy("half", "batch")).applyInPandas(_region((np.array(cuts, dtype=np.int64), reach), own, factor), f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, cost double, path array<long>"), "decided")
        found = got if found is None else found.union(got)
        rest, last, reach = stored(rest.join(got, "pair_id", "left_anti"), "pairs"), reach >= halves, 2 * reach
    rest = rest.drop("half")
    if found is None:
        found = edges.sparkSession.createDataFrame([], f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, cost double, path array<long>")
    return found.where("path is not null"), rest
