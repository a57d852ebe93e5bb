"""Fixpoints whose rounds are stored: what each round adds is appended, nothing is written twice, and all of it can be deleted at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .network import drop_folder, fresh_folder, stored


class Rounds:
    """Rows found round by round, in one folder of spark.checkpoint.dir with a part for each round."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.schema, self.path, self.n = first.sparkSession, first.schema, fresh_folder(first.sparkSession, name), 0
        self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        """Stores a round and gives it back, as read."""
        part = f"{self.path}/round={self.n}"
        rows.select(*self.schema.names).write.parquet(part)
        self.n += 1
        return self.last()

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={self.n - 1}")

    def all(self) -> DataFrame:
        """Every round's rows, with their round."""
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("round", T.IntegerType())])).parquet(self.path)

    def drop(self) -> None:
        drop_folder(self.spark, self.path)


def ancestors(parents: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, node, back): the way from each of targets(key, tree, node) up to its root, by pointer doubling.

    parents(tree, node, pred), pred null at the root. Jumps of 1, 2, 4, ... steps are made by joining jumps with themselves, so a way of n
    nodes takes log n joins, whatever the graph's size; back is 0 for the target itself.
    """
    jumps = [stored(parents.where("pred is not null").select("tree", "node", "pred"), "jumps")]
    while jumps[-1].take(1):
        one = jumps[-1]
        two = one.select("tree", F.col("node").alias("pred"), F.col("pred").alias("far"))
        jumps.append(stored(one.join(two, ["tree", "pred"]).select("tree", "node", F.col("far").alias("pred")), "jumps"))
    found = targets.select("key", "tree", "node", F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(jumps) - 1)):
        found = found.union(found.join(jumps[k], ["tree", "node"]).select("key", "tree", F.col("pred").alias("node"), (F.col("back") + (1 << k)).alias("back")))
        found = stored(found, "ways")
    return found.select("key", "node", "back")
