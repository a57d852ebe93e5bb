"""GTFS tables: readers, and the patterns of trips that run."""

from __future__ import annotations

import csv
import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Files that a feed can't do without.
REQUIRED = ("stops.txt", "routes.txt", "trips.txt", "stop_times.txt")


def read_table(spark: SparkSession, path: str, name: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """One file of a feed, all columns as text: `path` is a folder, a zip file, or a folder of zip files (then with the column `feed`).

    Of a zip the member is found by its name in whatever folder; a byte order mark is skipped, blanks at the ends of names are, too. A feed
    without a file of REQUIRED fails, naming it; of others an empty table with `columns` comes back. Columns that are asked for and absent are null.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    zipped = fs.getFileStatus(at).isFile() or bool(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/*.zip")))
    if zipped:
        found = _members(spark, path, name)
    elif fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
        found = spark.read.csv(f"{path}/{name}", header=True, encoding="UTF-8", multiLine=True)
    elif name in REQUIRED:
        raise ValueError(f"the feed has no {name}")
    else:
        found = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns or ("none",)))
    found = found.toDF(*(c.strip("\ufeff ") for c in found.columns))
    return found.withColumns({c: F.lit(None).cast("string") for c in columns if c not in found.columns})


def _members(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The member of every zip as rows; a task reads a zip, row by row."""
    zips = spark.read.format("binaryFile").load(path)
    missing = f"the feed has no {name}" if name in REQUIRED else ""

    def lines(content):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            member = next((n for n in z.namelist() if n.split("/")[-1] == name), None)
            if member is None:
                if missing:
                    raise ValueError(missing)
                return
            with z.open(member) as raw:
                yield from csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))

    def heads(frames):
        for frame in frames:
            for content in frame["content"]:
                head = next(lines(content), None)
                yield pd.DataFrame({"name": [c.strip() for c in head or ()]}, dtype=str)

    names = sorted(r[0] for r in zips.select("content").mapInPandas(heads, "name string").distinct().collect() if r[0])  # column names

    def rows(frames):
        for frame in frames:
            for feed, content in zip(frame["path"], frame["content"]):
                found, held = lines(content), []
                head = [c.strip() for c in next(found, ())]
                for row in found:
                    held.append([feed, *(dict(zip(head, row)).get(c) or None for c in names)])
                    if len(held) >= 10_000:
                        yield pd.DataFrame(held, columns=["feed", *names])
                        held = []
                yield pd.DataFrame(held, columns=["feed", *names])

    return zips.select("path", "content").mapInPandas(rows, ", ".join(f"`{c}` string" for c in ("feed", *names)))


def seconds(text) -> Column:
    """Seconds after midnight of H:MM:SS, where H may exceed 23; null for blanks and what is no time."""
    parts = F.split(F.trim(F.col(text) if isinstance(text, str) else text), ":")
    h, m, s = (F.get(parts, F.lit(k)).try_cast("int") for k in range(3))
    return F.when(F.size(parts) == 3, h * 3600 + m * 60 + s)


def boarding_stops(stops: DataFrame, wheelchair: bool = False) -> DataFrame:
    """stop_id, stop_name, lon, lat of places where one boards (no stations or entrances; with wheelchair none marked 2)."""
    kept = stops.where(F.trim(F.coalesce("location_type", F.lit("0"))).isin("", "0"))
    if wheelchair:
        kept = kept.where(F.trim(F.coalesce("wheelchair_boarding", F.lit(""))) != "2")
    return kept.select("stop_id", F.coalesce("stop_name", "stop_id").alias("stop_name"), F.col("stop_lon").try_cast("double").alias("lon"), F.col("stop_lat").try_cast("double").alias("lat")).where("lon is not null and lat is not null")


def running_times(stop_times: DataFrame, trips: DataFrame, stops: DataFrame, services: DataFrame, wheelchair: bool = False) -> DataFrame:
    """trip_id, route_id, seq, stop_id, arrival, departure of trips whose service runs, at known stops; one time stands in for the other, stops without one go."""
    running = trips.join(services.select("service_id").distinct(), "service_id", "left_semi")
    if wheelchair:
        running = running.where(F.trim(F.coalesce("wheelchair_accessible", F.lit(""))) == "1")
    timed = stop_times.select("trip_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("seq"), seconds("arrival_time").alias("a"), seconds("departure_time").alias("d"))
    timed = timed.select("trip_id", "stop_id", "seq", F.coalesce("a", "d").alias("arrival"), F.coalesce("d", "a").alias("departure")).where("arrival is not null")
    return timed.join(running.select("trip_id", "route_id"), "trip_id").join(stops.select("stop_id"), "stop_id", "left_semi").select("trip_id", "route_id", "seq", "stop_id", "arrival", "departure")


def patterns(times: DataFrame) -> DataFrame:
    """trip_id, route_id, stops (array), place (0 for the first departure): trips of one route with equal stops form a pattern; trips of one stop go."""
    by_trip = times.groupBy("trip_id", "route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stop_id", "departure"))).alias("s")).where("size(s) >= 2")
    rows = by_trip.select("trip_id", "route_id", F.col("s.stop_id").alias("stops"), F.get("s", F.lit(0))["departure"].alias("departure"))
    place = F.row_number().over(Window.partitionBy("route_id", "stops").orderBy("departure", "trip_id")) - 1
    return rows.select("trip_id", "route_id", "stops", "departure", place.cast("long").alias("place"))
