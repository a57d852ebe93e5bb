"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Random Fourier features approximate a Gaussian kernel over standardised statistics of the text.
Partitions of the labelled sample sum their normal equations for two folds; each fold's ridge
solution scores the other fold, on which a monotone calibration is fitted; the solution of both
folds scores all documents. Only the sample, of bounded size, and the sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, Keyed, Words, batches, encoded, give_back, small_batches, stored, tidied
from .spans import CHARS

#: Labelled documents that the model is fitted on, at most about (chosen by hash of the id).
SAMPLE = 20_000
FEATURES = 256
RIDGE = 1e-3
THRESHOLD = 0.3
SEED = 5

_CLASSES = {
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "period": [46],
    "comma": [44],
    "bang": [33, 63],
    "bar": [124],
    "marks": [35, 36, 37, 38, 42],
    "markup": [60, 62, 91, 93, 123, 125, 92, 95, 94, 126, 96, 64, 61, 43],
    "quote": [34, 39, 40, 41, 45, 47, 58, 59],
    "space": [9, 11, 12, 13, 32],
    "line": [10],
    "high": [*range(128, 256)],
}
STATISTICS = ("bytes", *_CLASSES, "words", "word_bytes", "word_spread", "short_words", "long_words", "distinct", "again", "again2", "again3", "capital", "last_mark", "line_words", "line_distinct")


def _each(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sums of values over ranges."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[stop] - total[start]


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text: shares of kinds of bytes, sizes of words, repetition of words and lines."""
    words = Words(texts)
    data, n = words.data, len(texts)
    start, stop = words.text_start, words.text_start + np.array([len(t) for t in texts], dtype=np.int64)
    size = np.maximum(stop - start, 1).astype(float)
    columns = [np.log1p(stop - start)]
    for kinds in _CLASSES.values():
        table = np.zeros(256, dtype=np.float32)
        table[kinds] = 1
        columns.append(_each(table[data], start, stop) / size)
    first, last = words.first, words.last
    count = np.maximum(last - first, 1).astype(float)
    length = (words.stop - words.start).astype(float)
    owner = np.repeat(np.arange(n), last - first)
    mean = _each(length, first, last) / count
    columns += [np.log1p(last - first), mean, np.sqrt(np.maximum(_each(length**2, first, last) / count - mean**2, 0))]
    columns += [_each(length <= 3, first, last) / count, _each(length >= 16, first, last) / count]
    # Repetition over the first hundreds of words and over all of them differ by length; the root evens that.
    columns.append(_distinct(words.hash, owner, n) / count**0.85)
    for back in (1, 2, 3):
        same = np.zeros(len(words.hash))
        same[back:] = (words.hash[back:] == words.hash[:-back]) & (owner[back:] == owner[:-back])
        columns.append(_each(same, first, last) / count)
    head, tail = data[words.start] if len(owner) else data[:0], data[words.stop - 1] if len(owner) else data[:0]
    columns.append(_each((head >= 65) & (head <= 90), first, last) / count)
    letter = ((tail >= 48) & (tail <= 57)) | ((tail >= 65) & (tail <= 90)) | ((tail >= 97) & (tail <= 122)) | (tail >= 128)
    columns.append(_each(~letter, first, last) / count)
    lines = [t.split(b"\n") for t in texts]
    columns.append(np.log1p(np.array([len(x) for x in lines])) - np.log1p(last - first))
    columns.append(np.array([len(set(x)) / len(x) for x in lines]))
    return np.stack(columns, axis=1)


def _describe(frames):
    for group in batches(frames, "__text", CHARS):
        frame = pd.concat(group)
        rows = statistics(encoded(frame["__text"]))
        yield pd.DataFrame({KEY: frame[KEY].to_numpy(), "x": list(rows)})


class Fourier:
    """Random Fourier features of standardised statistics."""

    def __init__(self, sample: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = sample.mean(axis=0), sample.std(axis=0) + 1e-6
        d = sample.shape[1]
        self.w = rng.standard_normal((d, features)) / np.sqrt(d)
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        wave = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.hstack((wave, np.ones((len(x), 1))))


def _sums(fourier: Fourier):
    """One row per fold and partition: its normal equations."""

    def run(frames):
        sums: dict[int, list] = {}
        for frame in frames:
            for fold, part in frame.groupby("fold"):
                z, y = fourier(np.stack(part["x"].tolist())), part["y"].to_numpy(float)
                held = sums.setdefault(int(fold), [0.0, 0.0, 0])
                held[0], held[1], held[2] = held[0] + z.T @ z, held[1] + z.T @ y, held[2] + len(y)
        yield pd.DataFrame([(f, np.asarray(a).ravel(), b, n) for f, (a, b, n) in sums.items()], columns=["fold", "zz", "zy", "n"])

    return run


def _total(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(frame["fold"].iloc[0], np.sum(np.stack(frame["zz"].tolist()), axis=0), np.sum(np.stack(frame["zy"].tolist()), axis=0), frame["n"].sum())], columns=["fold", "zz", "zy", "n"])


def solve(zz: np.ndarray, zy: np.ndarray, n: int, ridge: float = RIDGE) -> np.ndarray:
    penalty = ridge * n * np.eye(len(zy))
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(zz + penalty, zy)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y to score, by pooling adjacent violators."""
    xs, at = np.unique(score, return_inverse=True)
    weight = np.bincount(at).astype(float)
    value = np.bincount(at, weights=y) / weight
    blocks: list[list[float]] = []  # value, weight, weighted sum of scores
    for v, w, x in zip(value, weight, xs):
        blocks.append([v, w, w * x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, x2 = blocks.pop()
            v1, w1, x1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, x1 + x2])
    return np.array([x / w for _, w, x in blocks]), np.array([v for v, _, _ in blocks])


class Model:
    """Scores of statistics: calibrated, in the order of the ridge score."""

    def __init__(self, fourier: Fourier, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray]):
        self.fourier, self.weights, self.knots = fourier, weights, knots

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = self.fourier(x) @ self.weights
        even = 1 / (1 + np.exp(-4 * np.clip(raw - 0.5, -5, 5)))
        return np.clip(0.995 * np.interp(raw, *self.knots) + 0.005 * even, 0.0, 1.0)


def fit(sample: DataFrame) -> Model | None:
    """A model from sample(fold 0 or 1, x, y), which is of bounded size; None where a fold has no rows."""
    start = [np.array(r[0]) for r in sample.select("x").collect()]
    if not start:
        return None
    fourier = Fourier(np.stack(start))
    sums = sample.coalesce(8).mapInPandas(_sums(fourier), "fold int, zz array<double>, zy array<double>, n long")
    totals = {r["fold"]: r for r in sums.groupBy("fold").applyInPandas(_total, "fold int, zz array<double>, zy array<double>, n long").collect()}
    if set(totals) != {0, 1}:
        return None
    m = len(totals[0]["zy"])
    zz = {f: np.array(r["zz"]).reshape(m, m) for f, r in totals.items()}
    zy = {f: np.array(r["zy"]) for f, r in totals.items()}
    halves = {f: solve(zz[1 - f], zy[1 - f], totals[1 - f]["n"]) for f in (0, 1)}
    rows = sample.select("fold", "x", "y").collect()
    fold, x, y = np.array([r["fold"] for r in rows]), np.stack([np.array(r["x"]) for r in rows]), np.array([r["y"] for r in rows], dtype=float)
    z = fourier(x)
    raw = np.where(fold == 0, z @ halves[0], z @ halves[1])
    return Model(fourier, solve(zz[0] + zz[1], zy[0] + zy[1], len(y)), isotonic(raw, y))


def _score(model: Model | None, base: float):
    def run(frames):
        for frame in frames:
            score = model(np.stack(frame["x"].tolist())) if model and len(frame) else np.full(len(frame), base)
            yield pd.DataFrame({KEY: frame[KEY], "score": score})

    return run


def teachers(labels: DataFrame, sample_size: int = SAMPLE) -> tuple[DataFrame, int, float]:
    """(__doc, y) of about sample_size labelled ids at most, from labels(__doc, quality); the number of all, and their mean (0.5 without labels)."""
    teach = "__doc is not null and y in (0, 1) and crc32(cast(cast(__doc as string) as binary)) % 5 <> 0"
    known = labels.select("__doc", F.col("quality").cast("int").alias("y")).where(teach).groupBy("__doc").agg(F.min("y").alias("y"))
    n, base = known.agg(F.count("*"), F.avg("y")).first()
    share = sample_size / max(1, n)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("__doc", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return known, n, 0.5 if base is None else float(base)


def learn(described: DataFrame, labels: DataFrame, sample_size: int = SAMPLE) -> tuple[Model | None, float]:
    """A model from described(KEY, __doc, x) and labels(__doc, quality), and the labels' mean (0.5 without labels).

    Of rows that repeat an id, the one of the least key, and then of the least statistics, teaches.
    """
    known, n, base = teachers(labels, sample_size)
    one = described.join(F.broadcast(known), "__doc").groupBy("__doc").agg(F.min(F.struct(KEY, "x", "y")).alias("one"))  # however often an id is repeated
    sample = one.select(F.pmod(F.xxhash64("__doc", F.lit(SEED + 1)), F.lit(2)).cast("int").alias("fold"), "one.x", "one.y")
    return (fit(stored(sample, "sample")) if n else None), base


def text_scorer(model: Model | None, base: float):
    """The model as a vectorised function of a text column."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            scores = [np.full(0, base)]
            for group in batches([texts.to_frame("__text")], "__text", CHARS):
                rows = pd.concat(group)["__text"]
                scores.append(model(statistics(encoded(rows))) if model else np.full(len(rows), base))
            yield pd.Series(np.concatenate(scores))
        give_back()

    return score


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that quality_scores() predicts 0; texts do not shuffle, so rows need no unique ids."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias(KEY), F.col(text_col).alias("__text")).where(F.col(id_col).isNotNull())
    known = labels.select(F.col(id_col).cast("long").alias("__doc"), "quality")
    few = slim.join(F.broadcast(teachers(known)[0].select(F.col("__doc").alias(KEY))), KEY, "left_semi")  # only what teaches is described
    described = few.mapInPandas(tidied(_describe), "__key long, x array<double>").withColumn("__doc", F.col(KEY))
    model, base = learn(described, known)
    return docs.where(text_scorer(model, base)(F.col(text_col)) >= threshold)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_size: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    labels(doc_id, quality): rows with a null id, a quality other than 0 or 1, or an id whose
    crc32 mod 5 is 0 teach nothing; of several for one id the least counts. Null and empty texts are scored
    as empty ones. Without labels of both folds every score is the labels' mean, or 0.5.
    Repeated rows and rows with a null id (never held out) are documents of their own; an empty table gives an
    empty result; other columns are ignored. Scores depend on the texts and the learnt labels alone.
    """
    keyed = Keyed(docs, id_col, [F.col(text_col).alias("__text")], ["__text"])
    described = stored(keyed.df.select(KEY, "__text").mapInPandas(tidied(_describe), "__key long, x array<double>"), "statistics")
    ids = described if keyed.plain else described.join(keyed.ids, KEY)
    doc = F.col(KEY) if keyed.plain else F.col("__id")
    held = F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = ids.select(KEY, "x", doc.alias("__doc"), held.alias("held_out"))
    model, base = learn(rows, labels.select(F.col(id_col).cast("long").alias("__doc"), "quality"), sample_size)
    scored = described.mapInPandas(_score(model, base), "__key long, score double")
    scored = scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    if keyed.plain:
        return scored.select(F.col(KEY).alias("doc_id"), F.coalesce(F.crc32(F.col(KEY).cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
    return scored.join(rows.select(KEY, F.col("__doc").alias("doc_id"), "held_out"), KEY).select("doc_id", "held_out", "score", "predicted")
