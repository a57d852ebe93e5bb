"""Ordered folds of any length: steps are composed by blocks, so no task walks a whole chain."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .network import stored

#: Steps that one row holds.
BLOCK = 64


def scan(rows: DataFrame, first: DataFrame, apply: Callable[[Column, Column], Column], compose: Callable[[Column, Column], Column], block: int = BLOCK) -> DataFrame:
    """(key, at, state) after each step of rows(key, at, f), starting from first(key, state); `at` counts from 0 without gaps.

    apply(state, f) takes a step, compose(f, g) is the step that does f, then g; it must be associative. Each block of steps is composed into one, the
    chain of blocks is scanned in the same way, and each block is then walked from the state it is entered with: a chain of n steps costs
    log n joins (to the base of the block), however many of the rows belong to one key. Keys without a first state have no result.
    """
    blocks = rows.groupBy("key", F.floor(F.col("at") / block).cast("long").alias("b")).agg(F.array_sort(F.collect_list(F.struct("at", "f"))).alias("fs"))
    blocks = stored(blocks.withColumn("fs", F.transform("fs", lambda x: x["f"])), "blocks")
    entered = first.select("key", F.lit(0).cast("long").alias("b"), "state")
    if blocks.where("b > 0").take(1):
        whole = blocks.select("key", F.col("b").alias("at"), F.aggregate(F.expr("slice(fs, 2, size(fs))"), F.element_at("fs", 1), compose).alias("f"))
        entered = entered.union(scan(whole, first, apply, compose, block).select("key", (F.col("at") + 1).alias("b"), "state"))
    walked = F.aggregate("fs", F.array("state"), lambda done, f: F.concat(done, F.array(apply(F.element_at(done, -1), f))))
    states = blocks.join(entered, ["key", "b"]).select("key", "b", F.posexplode(walked).alias("k", "state"))
    return states.where("k > 0").select("key", (F.col("b") * block + F.col("k") - 1).alias("at"), "state")
