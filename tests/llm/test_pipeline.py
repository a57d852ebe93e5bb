"""The pipeline's stages against brute force, on a small part of the table with awkward rows."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from terrapace.llm.quality import quality_scores

from .test_ngram_join import brute
from .test_tables import squeeze

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [tuple(r) for r in table.collect()]
    extra = [(None, "a b c", "en", None, 5), (None, None, None, None, None), (3, rows[3][1], "en", "src0", 1), (3, "", "en", "src1", 1), (5000, rows[7][1] + " more", "en", "src0", 1), (5001, rows[7][1].upper(), "en", "src9", 1)]
    return spark.createDataFrame(rows + extra, table.schema).withColumn("size", p.F.lit(1)).withColumn("kept", p.F.lit("x")).selectExpr("*", "1 as __text", "2 as __key", "3 as __source", "4 as __row", "5 as __time")


def rows(df):
    return Counter(map(tuple, df.select("doc_id", "text").collect()))


def test_quality(spark, docs):
    kept = p.quality(spark, docs, DIR)
    assert kept.columns == docs.columns
    scores = quality_scores(docs, spark.read.parquet(f"{DIR}/labels.parquet")).where("predicted = 1").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in scores} == Counter(r.doc_id for r in kept.select("doc_id").collect())


def test_exact(spark, docs):
    kept = p.exact(spark, docs, DIR)
    assert kept.columns == docs.columns
    best = {}
    for doc_id, text in docs.select("doc_id", "text").collect():
        rank = (-len(text or ""), doc_id is not None, doc_id or 0)
        best[squeeze(text)] = min(best.get(squeeze(text), (rank, doc_id)), (rank, doc_id), key=lambda x: x[0])
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for _, d in best.values())


def test_near(spark, docs):
    kept = p.near(spark, docs, DIR)
    assert kept.columns == docs.columns
    groups = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], p.GRAM, p.PERCENT)
    assert kept.count() == len({(c, d if c is None else 0, i if c is None else 0) for i, (d, _, c) in enumerate(groups)} - {(3, 0, 0)}) + sum(1 for r in kept.collect() if r.doc_id == 3)
    assert {r.doc_id for r in kept.collect()} >= {c for _, _, c in groups}


def test_mixing_and_packing(spark, docs):
    mixed = p.mixing(spark, docs, DIR)
    assert mixed.columns == docs.columns
    before, after = rows(docs), rows(mixed)
    assert all(n <= 3 * before[k] for k, n in after.items())
    words = lambda c: sum(len((t or "").split()) * n for (_, t), n in c.items())
    assert abs(words(after) - words(before)) < 0.02 * words(before)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for (doc_id, text), n in after.items():
        want[doc_id] += n * (len(tok.encode(text or "", add_special_tokens=False).ids) + 1)
    got = Counter()
    for r in p.packing(spark, mixed, DIR).collect():
        got[r.doc_id] += len(np.frombuffer(r.ids, dtype="<u4"))
    assert got == want


def test_run(spark):
    out = p.run(spark, DIR)
    assert out.count() > 0
    assert out.groupBy("sequence_id").agg({"length": "sum", "sequence_length": "max"}).where("`sum(length)` <> `max(sequence_length)`").count() == 0


def test_empty(spark, docs):
    none = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, DIR).count() == 0
