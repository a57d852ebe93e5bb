"""Substring deduplication by words: super-k-mer partitioning (see spans for the flow).

Consecutive windows of 35 words with one minimiser (the least hash among the window's runs of 8
words) form a super-k-mer, which travels as one packed string to its minimiser's bucket; there
the windows are sorted and counted exactly.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, Keyed, Prefix, Words, digests, mix, sliding_min, tidied
from .spans import BUCKET, covered, repeated_ranges

WINDOW = 35
MINIMISER = 8


def _windows(texts: list[bytes], size: int, sub: int):
    words = Words(texts)
    n = len(words.hash) - size + 1
    if n <= 0:
        return
    prefix = Prefix(words.hash)
    parts = mix(prefix.windows(sub))
    least = sliding_min(parts, size - sub + 1)
    text = np.repeat(np.arange(len(texts)), words.last - words.first)
    valid = np.flatnonzero(np.arange(n) + size <= words.last[text[:n]])
    owner = text[valid]
    at = valid - words.first[owner]
    # Windows between texts are left out, so a run of valid windows never spans two texts.
    data, begin = words.packed()
    yield 0, least[valid], parts[valid + size - sub] == least[valid], at, lambda a, b: digests(data, begin[valid[a]], begin[valid[b - 1] + size] - 1), owner


def _content(data: bytes, size: int):
    words = data.split()
    return lambda start, n: b" ".join(words[start : start + n - 1 + size])


def _resolve(contents: list[bytes], group: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sorts the windows of each bucket and numbers the distinct ones; equal hashes are compared word by word."""
    words = Words(contents)
    prefix = Prefix(words.hash)
    span = np.repeat(np.arange(len(n)), n)
    at = words.first[span] + np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
    hashes = prefix.slices(at, at + size)
    order = np.lexsort((hashes, group[span]))
    same = (hashes[order][1:] == hashes[order][:-1]) & (group[span][order][1:] == group[span][order][:-1])
    data = words.data.tobytes()
    a, b = words.start[at[order]], words.stop[at[order] + size - 1]
    for i in np.flatnonzero(same).tolist():
        if data[a[i] : b[i]] != data[a[i + 1] : b[i + 1]]:
            same[i] = False
    classes = np.empty(len(span), dtype=np.int64)
    classes[order] = np.concatenate(([0], np.cumsum(~same))) if len(span) else 0
    return classes


def _window_bytes(contents: list[bytes], span: np.ndarray, inner: np.ndarray, size: int) -> list[bytes]:
    split: dict[int, list[bytes]] = {}
    out = []
    for k, i in zip(span.tolist(), inner.tolist()):
        words = split.get(k)
        if words is None:
            words = split[k] = contents[k].split()
        out.append(b" ".join(words[i : i + size]))
    return out


def _apply(size: int):
    def run(frames):
        for frame in frames:
            rows = []
            for key, text, ranges in zip(frame[KEY].tolist(), frame["__text"], frame["__ranges"]):
                words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
                gone = covered(ranges, len(words), size)
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if ranges is not None else b" ".join(words)
                rows.append((key, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=[KEY, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, sub: int = MINIMISER, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes when a window of `size` words that covers it also starts anywhere else, in the
    same or another document. Kept words are joined by one space. Null and empty texts have no words; texts
    shorter than a window lose none. Repeated rows and rows with a null id are documents of their own, so
    their windows count as repeated. An empty table gives an empty result; other columns are ignored.
    """
    keyed = Keyed(docs, id_col, [F.col(text_col).alias("__text")], ["__text"])
    base = keyed.df.select(KEY, "__text").where(F.col(KEY).isNotNull())
    fixed = {"size": size}
    ranges = repeated_ranges(base, partial(_windows, size=size, sub=min(sub, size)), partial(_content, **fixed), partial(_resolve, **fixed), partial(_window_bytes, **fixed), first_stays=False, bucket=bucket)
    out = base.join(ranges, KEY, "left").mapInPandas(tidied(_apply(size)), "__key long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return keyed.restore(out, {KEY: "doc_id"}).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
