"""Whitening against numpy on whole tables, with awkward rows."""

import math
from collections import defaultdict

import numpy as np
import pytest

from terrapace.llm import whitening
from terrapace.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<double>, component int, n int, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, 4, "x") for i, v in rows], SCHEMA)


def brute(rows, most=16):
    """{dimensions: (n, eigenvalues, whitened covariance's basis, centre)} and the rows kept, quantised."""
    kept = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    models = {}
    for dim in {len(x) for _, x in kept if x}:
        fit = np.array(sorted({x for _, x in kept if len(x) == dim}), dtype=np.int64)
        n, sums = len(fit), fit.sum(axis=0)
        centred = (fit * n - sums) / n
        values = np.linalg.eigvalsh(centred.T @ centred / n)[::-1][:most]
        models[dim] = n, [int(s) for s in sums], values, centred, float(np.trace(centred.T @ centred / n))
    return kept, models


def check(rows, got, most=16):
    kept, models = brute(rows, most)
    assert len(got) == sum(min(most, len(x)) for _, x in kept)
    by = defaultdict(lambda: defaultdict(list))
    for r in got:
        by[r.vec_id][r.component].append(r)
    for dim, (n, sums, values, centred, trace) in models.items():
        mine = [(i, x) for i, x in kept if len(x) == dim]
        for i, x in mine:
            for k in range(min(most, dim)):
                same = [r for r in by[i][k + 1] if r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))]
                assert same
                if trace > 0 and values[k] > 1e-9 * trace:
                    assert same[0].explained == pytest.approx(values[k] / trace, rel=1e-9) and same[0].identity_error < 1e-8
                else:
                    assert same[0].whitened is None and same[0].explained == (pytest.approx(0, abs=1e-9) if trace > 0 else None)
    return by, models


def test_whitening_is_that_of_numpy(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 20)) @ rng.standard_normal((20, 20)) + 40
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[7].tolist()) for i in range(500)]  # copies weigh nothing
    by, models = check(rows, whiten(frame(spark, rows).repartition(7)).collect())
    n, sums, values, centred, _ = models[20]
    w = np.array([[by[i][k][0].whitened for k in range(1, 17)] for i in range(300)])
    # Distances along the components are those of the covariance's own eigenvectors, signs aside.
    vectors = np.linalg.eigh(centred.T @ centred / n)[1][:, ::-1][:, :16]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in base.tolist()]) - np.array(sums) / n
    want = x @ vectors / np.sqrt(values)
    assert np.allclose(w * np.sign((w * want).sum(axis=0)), want, atol=1e-6)
    assert len({round(by[1000 + i][1][0].whitened, 9) for i in range(500)} | {round(by[7][1][0].whitened, 9)}) == 1


def test_sums_are_the_same_however_rows_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(9) * 3 + 1).tolist()) for i in range(200)]
    result = lambda n: sorted(map(tuple, whiten(frame(spark, rows).repartition(n)).drop("identity_error").collect()))
    first = result(2)
    monkeypatch.setattr(whitening, "TILE", 2)
    assert result(5) == first


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.5, -2.0]), (2, [1.5, -2.0]), (None, [0.25, 7.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [-0.001, 0.0])]
    got = whiten(frame(spark, rows)).collect()
    check(rows, got)
    assert {r.vec_id for r in got} == {1, 2, None, 8, 9} and sum(r.vec_id == 2 for r in got) == 4
    assert all(r.whitened is None and r.explained is None and r.identity_error == 0 for r in got if r.vec_id == 8)
    assert whiten(frame(spark, [])).count() == 0 and whiten(frame(spark, [(1, None)])).count() == 0


def test_far_entries_and_flat_dimensions(spark):
    rows = [(i, [float(i), 5.0, 3.0e9 * (i % 3), 2.0 * i]) for i in range(40)]
    check(rows, whiten(frame(spark, rows)).collect())
    far = whiten(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])])).collect()
    assert len(far) == 6 and all(r.deviation is None or r.deviation >= 0 for r in far)


def test_components_asked_for(spark):
    rows = [(i, [float(i % 7), float(i % 5), float(i % 3)]) for i in range(50)]
    assert {r.component for r in whiten(frame(spark, rows), most=2).collect()} == {1, 2}
