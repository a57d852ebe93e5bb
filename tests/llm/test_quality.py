"""The quality classifier: held-out accuracy, isotonic fit and awkward rows."""

import zlib

import numpy as np

from terrapace.llm import quality
from terrapace.llm.quality import STATISTICS, isotonic, quality_scores, statistics


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    y, s = held["quality"].to_numpy(), held["score"].to_numpy()
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    auc = (rank[y == 1].mean() - rank[y == 0].mean()) / len(s) + 0.5
    accuracy = (held["predicted"] == y).mean()
    assert auc > 0.97 and accuracy > 0.95, (auc, accuracy)
    assert ((s >= 0) & (s <= 1)).all()


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    x = rng.random(200)
    y = (rng.random(200) < x).astype(float)
    knots, values = isotonic(x, y)
    assert (np.diff(knots) > 0).all() and (np.diff(values) > 0).all()
    assert isotonic(np.array([1.0, 1.0, 2.0]), np.array([1.0, 0.0, 0.0]))[1].tolist() == [1 / 3]


def test_statistics_take_any_text():
    rows = statistics([b"", b"a", b"\n\n", "é é é".encode(), b"word " * 50_000])
    assert rows.shape == (5, len(STATISTICS)) and np.isfinite(rows).all()
    alone = np.concatenate([statistics([t]) for t in (b"", b"a", b"\n\n", "é é é".encode())])
    assert np.allclose(rows[:4], alone, atol=1e-6)


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(i, f"some text {i} " * (i % 7)) for i in range(200)] + [(1, "again"), (1, "again"), (None, None), (None, "x"), (900, "")], "doc_id long, text string").selectExpr("*", "1 as score", "'x' as quality")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200, 2)] + [(2, 0), (None, 1), (4, None), (6, 7)], "doc_id long, quality int").selectExpr("*", "1 as x")
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == 205 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_a_repeated_id_teaches_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda sample: seen.extend(sample.collect()))
    described = spark.createDataFrame([(k, [float(k)], 7 if k < 300 else k) for k in range(320)], "__key long, x array<double>, __doc long").repartition(3)
    labels = spark.createDataFrame([(7, 1), (7, 1), *((k, k % 2) for k in range(300, 320))], "__doc long, quality int")
    quality.learn(described, labels)
    taught = [k for k in (7, *range(300, 320)) if zlib.crc32(str(k).encode()) % 5]
    assert 7 in taught and sorted((r.x[0], r.y) for r in seen) == [(0.0, 1) if k == 7 else (float(k), k % 2) for k in taught]
