"""Every registered query that has SQL, against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from terrapace.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def plain(rows):
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 3) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(map(clean, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    got = registry.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = plain(tuple(r[c] for c in columns) for r in got.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    wanted = tables.execute(registry.ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = plain(tuple(r[i] for i in at) for r in wanted.fetchall())
    assert len(rows) == len(want)
    off = sum(a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-3) for x, y in zip(a, b)) for a, b in zip(rows, want))
    assert off == 0
