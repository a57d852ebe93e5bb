"""Watching a folder of results: each new file is announced as an event row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_events(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the rows of new files, with the file's name and time."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumns({"file": F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "changed": F.col("_metadata.file_modification_time")})


def on_change(events: DataFrame, notify: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls notify for each batch of new files, exactly once per batch and file set; returns the running query."""
    return events.writeStream.foreachBatch(notify).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per key and window of event time; late ones count until the watermark has passed."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
