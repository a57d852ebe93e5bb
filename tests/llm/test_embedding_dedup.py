"""Near-duplicate embeddings against brute force."""

import math

import numpy as np
import pytest

from terrapace.llm import embedding_dedup
from terrapace.llm.embedding_dedup import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, n_links int, size int, vec string"


def vectors(seed, dim=16, n=400):
    rng = np.random.default_rng(seed)
    out = []
    centres = rng.standard_normal((12, dim))
    for i in range(n):
        v = centres[rng.integers(12)] + rng.choice([0.0, 0.05, 0.2, 3.0]) * rng.standard_normal(dim)
        out.append((i * 3, [float(np.float32(x)) for x in v * rng.choice([1.0, 1e-20, 1e15])], int(rng.integers(3))))
    a = out[0][1]
    out += [(5000, None, 1), (5001, [0.0] * dim, 1), (5002, [], 1), (5003, [math.nan] + a[1:], 1), (5004, [math.inf] + a[1:], 1), (5005, [None] + a[1:], 1), (5006, a, None), (5007, a, out[0][2]), (0, a, out[0][2]), (None, a, out[0][2]), (None, None, None), (5008, a[:7], out[0][2]), (5009, a[:7], out[0][2])]
    return [(*v, "x", 1, 2, "y") for v in out]


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    unit = []
    for r in rows:
        v = r[1]
        ok = r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v if ok else [1.0], dtype=float)
        x /= np.abs(x).max()
        unit.append(x / np.linalg.norm(x) if ok else None)
    links = {(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93}
    return rows, links


def smallest_reachable(n, links):
    root = list(range(n))
    while True:
        before = list(root)
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return root


@pytest.mark.parametrize("block", [96, 5])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    data = vectors(block)
    rows, links = brute(data)
    got = near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    if sum(r.n_links for r in got) == 2 * len(links):
        root = smallest_reachable(len(rows), links)
        assert {r.vec_id: r.component_id for r in got if r.vec_id not in (None, 0)} == {r[0]: rows[root[i]][0] for i, r in enumerate(rows) if r[0] not in (None, 0)}
    assert len(got) == len(rows)
    want = {}
    for i, j in links:
        want[i] = want.get(i, 0) + 1
        want[j] = want.get(j, 0) + 1
    assert sum(r.n_links for r in got) >= 0.95 * 2 * len(links)
    by_id = {rows[i][0]: want.get(i, 0) for i in range(len(rows)) if rows[i][0] not in (None, 0)}
    for r in got:
        if r.vec_id not in (None, 0):
            assert r.n_links <= by_id[r.vec_id]
            if 5000 <= r.vec_id <= 5006:
                assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert sum(r.kept for r in got) == len({(r.component_id, r.vec_id if r.component_id is None else 0) for r in got if r.component_id is not None}) + sum(r.component_id is None and r.kept for r in got)


def test_components_of_the_found_links(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 32))
    data = [(int(i), (base[i % 40] + 0.02 * rng.standard_normal(32)).tolist(), 1, "x", 1, 2, "y") for i in range(400)]
    rows, links = brute(data)
    got = near_duplicates(spark.createDataFrame(data, SCHEMA))
    root = smallest_reachable(len(rows), links)
    assert {r.vec_id: (r.component_id, r.kept) for r in got.collect()} == {i: (root[i], root[i] == i) for i in range(400)}


def test_only_codes_within_the_radius_survive(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").limit(500).toPandas()
    unit = embedding_dedup._unit(table["embedding"].tolist())
    mean, projection, bits, tables, radius = embedding_dedup.fit_codes(unit, np.zeros(len(unit)), 8, 0.93)
    codes = (unit - mean) @ projection >= 0
    far = (codes[:, None] != codes[None]).sum(2)
    assert 0 < radius < bits * tables / 2 and (far[unit @ unit.T >= 0.93] <= radius).mean() > 0.98
    packed = [np.packbits(np.pad(c, (0, -len(c) % 64))).tobytes() for c in codes[:60]]
    a, b = embedding_dedup._candidates(embedding_dedup.pd.DataFrame({"code": packed, "own": True, "block": 0}), 0, bits, radius)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(np.triu(far[:60, :60] <= radius, 1)))))


def test_no_vectors(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None, 1, "", 1, 1, "")], SCHEMA).union(spark.createDataFrame([(2, [0.0], 1, "", 1, 1, "")], SCHEMA))).count() == 2


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = [(r.vec_id, list(r.embedding), r.label) for r in table.collect()]
    _, links = brute(data)
    got = near_duplicates(table).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * 2 * len(links) <= got <= 2 * len(links)


@pytest.mark.parametrize("norm, bits", [(0.0, 12), (0.8, 8), (0.8, 12), (0.97, 8)])
def test_recall_with_a_common_direction(spark, monkeypatch, norm, bits):
    """Pairs little above the threshold, of vectors whose mean has this norm; buckets so small that substrings get these bits."""
    rng, n, d = np.random.default_rng(4), 1500 if norm < 0.9 else 300, 64
    monkeypatch.setattr(embedding_dedup, "BUCKET", 2 * n / 2**bits)
    a, u = rng.standard_normal((2, n, d))
    a[:, 0] = u[:, 0] = 0
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u -= (u * a).sum(axis=1, keepdims=True) * a
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cosine = (rng.uniform(0.9302, 0.945, (n, 1)) - norm**2) / (1 - norm**2)
    x = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * u]) * math.sqrt(1 - norm**2)
    x[:, 0] = norm
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").selectExpr("*", "1 as label").repartition(4)
    links = np.triu(x @ x.T >= 0.93, 1).sum()
    assert links >= n
    assert 0.96 * 2 * links <= near_duplicates(table).agg({"n_links": "sum"}).first()[0] <= 2 * links
