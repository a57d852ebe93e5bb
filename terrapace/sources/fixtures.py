"""Spatial views derived by arithmetic from the driver's tables, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each view as SQL that both engines read, but for DIV, which stands for integer division.
VIEWS = {
    "zones": "SELECT c_custkey AS zone_id, 27.10e0 + (c_custkey % 97) * 0.0007e0 AS lon, 38.40e0 + ((c_custkey * 7) % 89) * 0.0006e0 AS lat, greatest(1e0, abs(c_acctbal)) AS population FROM customer",
    "facilities": "SELECT s_suppkey AS facility_id, 27.10e0 + ((s_suppkey * 13) % 97) * 0.0007e0 AS lon, 38.40e0 + ((s_suppkey * 29) % 89) * 0.0006e0 AS lat, greatest(1e0, abs(s_acctbal)) AS capacity FROM supplier",
    "side": "SELECT cast(floor(sqrt(count(*))) AS bigint) AS s FROM part",
    "grid_nodes": "SELECT p_partkey AS node_id, p_partkey % s AS i, p_partkey DIV s AS j, 27.10e0 + (p_partkey % s) * 0.0005e0 AS lon, 38.40e0 + (p_partkey DIV s) * 0.0005e0 AS lat, 40e0 + p_size * 0.5e0 AS z, p_retailprice AS dem, 20e0 + p_size * 0.6e0 AS lst, (p_partkey % 100) / 100e0 AS ndvi FROM part, side WHERE p_partkey < s * s",
    "grid_segments": "SELECT a.node_id AS u, b.node_id AS v, a.lon AS lon1, a.lat AS lat1, a.z AS z1, b.lon AS lon2, b.lat AS lat2, b.z AS z2, a.di, (31 * a.i + 17 * a.j + a.di) % 23 AS code FROM (SELECT n.*, d.di, n.i + 1 - d.di AS to_i, n.j + d.di AS to_j FROM grid_nodes n, (SELECT 0 AS di UNION ALL SELECT 1 AS di) d) a JOIN grid_nodes b ON b.i = a.to_i AND b.j = a.to_j",
    "routes": "SELECT l_orderkey AS route_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq, 27.10e0 + (l_partkey % 100) * 0.0001e0 AS lon, 38.40e0 + (l_suppkey % 100) * 0.0001e0 AS lat, l_quantity AS z FROM lineitem",
    "tracks": "SELECT track_id, seq, t, 27.10e0 + (seq % 40) * 0.0002e0 AS lon, 38.40e0 + (track_id % 40) * 0.0005e0 + (value - 50) * 1e-7 AS lat FROM (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS seq, ts AS t, value FROM events) e",
    "stop_times": "SELECT route_id AS trip_id, seq AS stop_sequence, l_suppkey AS stop_id, (route_id % 600) * 60 + seq * 300 AS arrival, (route_id % 600) * 60 + seq * 300 + 30 AS departure FROM (SELECT l_orderkey AS route_id, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq FROM lineitem) x",
    "samples": "SELECT l_orderkey AS k, l_linenumber AS n, (l_linenumber - 4) * 0.1e0 + l_discount * 2 - l_tax AS s, l_quantity * 10 AS d, 50 + l_tax * 500 AS m, l_quantity AS kmh, l_linenumber % 6 AS rank, l_partkey % 5 AS lanes, 27.1e0 + (l_partkey % 100) * 0.001e0 AS lon1, 38.4e0 + (l_suppkey % 100) * 0.001e0 AS lat1, 27.1e0 + (l_orderkey % 97) * 0.001e0 AS lon2, 38.4e0 + l_quantity * 0.001e0 AS lat2, l_quantity AS z1, l_extendedprice / 1000 AS z2 FROM lineitem",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
NEEDS = {"grid_nodes": ("side",), "grid_segments": ("side", "grid_nodes")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view; Spark plans it like any query over the tables."""
    known = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in " ".join(VIEWS[v] for v in (*NEEDS.get(name, ()), name))}
    for v in (*NEEDS.get(name, ()), name):
        known[v] = spark.sql(VIEWS[v].replace("FROM grid_nodes n", "FROM {grid_nodes} n").replace("JOIN grid_nodes b", "JOIN {grid_nodes} b").replace("part, side", "{part}, {side}").replace("FROM part", "FROM {part}") if v in ("side", "grid_nodes", "grid_segments") else _named(VIEWS[v], known), **{k: x for k, x in known.items() if _uses(v, k)})
    return known[name]


def _uses(view_name: str, table: str) -> bool:
    uses = {"side": ("part",), "grid_nodes": ("part", "side"), "grid_segments": ("grid_nodes",)}
    return table in uses.get(view_name, ()) if view_name in uses else table in TABLES


def _named(text: str, known: dict) -> str:
    for t in TABLES:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}")
    return text


def with_views(*names: str) -> str:
    """A WITH clause that defines the views for DuckDB."""
    order: list[str] = []
    for n in names:
        order += [v for v in (*NEEDS.get(n, ()), n) if v not in order]
    return "WITH RECURSIVE " + ",\n".join(f"{v} AS ({VIEWS[v].replace('DIV', '//')})" for v in order)
