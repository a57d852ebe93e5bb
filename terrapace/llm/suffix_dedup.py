"""Deduplication of byte strings by a hash-compared suffix sort (see spans for the flow).

In a bucket, the suffixes that start its windows are sorted by merging: two suffixes are compared
by their longest common extension, which prefix polynomial hashes and a binary search over its
length find in a logarithmic number of steps. Neighbours with a common extension of the window's
length hold equal strings. Bytes must confirm that, and the order of all neighbours: a group that hashes
put in a wrong order is sorted again by its bytes.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, KEY, Keyed, Prefix, digests, mix, sliding_min, tidied
from .spans import BUCKET, covered, repeated_ranges

WINDOW = 100
MINIMISER = 32
#: Bytes hashed at a time; longer texts are read in overlapping pieces.
PIECE = 2 << 20


def _windows(texts: list[bytes], size: int, sub: int, most: int = PIECE):
    """Longer texts alone, in pieces that overlap by size - 1; the others together."""
    short = [len(t) <= most for t in texts]
    parts = [(0, [t if ok else b"" for t, ok in zip(texts, short)], None)]
    for k, (t, ok) in enumerate(zip(texts, short)):
        if not ok:
            parts += [(at, [t[at : at + most + size - 1]], k) for at in range(0, max(1, len(t) - size + 1), most)]
    for offset, some, only in parts:
        raw = b"".join(some)
        data = np.frombuffer(raw, dtype=np.uint8)
        n = len(data) - size + 1
        if n <= 0:
            continue
        prefix = Prefix(BYTE[data])
        subs = mix(prefix.windows(sub))
        least = sliding_min(subs, size - sub + 1)
        lengths = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
        first = np.cumsum(lengths) - lengths
        counts = np.maximum(lengths - size + 1, 0)
        owner = np.repeat(np.arange(len(some)), counts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        valid = first[owner] + at
        text = owner if only is None else np.full(len(owner), only)
        yield offset, least[valid], subs[valid + size - sub] == least[valid], at, lambda a, b, valid=valid, raw=raw: digests(raw, valid[a], valid[b - 1] + size), text


def _content(data: bytes, size: int):
    return lambda start, n: data[start : start + n - 1 + size]


def common_extension(prefix: Prefix, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length, up to most, on which the suffixes at a and b agree, by binary search over prefix hashes."""
    at, back, last = prefix.at, prefix.back, len(prefix.at) - 1
    a0, b0, back_a, back_b = at[a], at[b], back[a], back[b]
    room = np.minimum(most, last - np.maximum(a, b))
    length = np.zeros(len(a), dtype=np.int64)
    step = 1 << (most.bit_length() - 1)
    while step:
        tried = length + step
        fits = tried <= room
        use = np.where(fits, tried, 0)
        same = (at[a + use] - a0) * back_a == (at[b + use] - b0) * back_b
        length = np.where(fits & same, tried, length)
        step >>= 1
    return length


def suffix_sort(prefix: Prefix, data: np.ndarray, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Stable order of the suffixes at `at` by (group, first `most` bytes); group is ascending.

    Bottom-up mergesort of all groups side by side: in each pass every suffix finds its place in
    the neighbouring run by binary search.
    """
    n = len(at)
    order = np.arange(n)
    if not n:
        return order
    new = np.concatenate(([True], group[1:] != group[:-1]))
    base = np.flatnonzero(new)
    size = np.diff(np.append(base, n))
    base, size = np.repeat(base, size), np.repeat(size, size)
    end = len(data) - 1
    head = np.zeros(n, dtype=np.uint64)
    for k in range(min(8, most)):
        head = (head << np.uint64(8)) | np.where(at + k <= end, data[np.minimum(at + k, end)], 0).astype(np.uint64)
    place = np.arange(n) - base
    run = 1
    while run < size.max():
        mine, first = at[order], head[order]
        r = place // run
        left = r % 2 == 0
        start = base + np.minimum((r ^ 1) * run, size)
        stop = base + np.minimum(((r ^ 1) + 1) * run, size)
        low, high = start.copy(), stop.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) // 2
            # The first eight bytes decide most comparisons; the others take the common extension.
            before = first[mid] < first[live]
            tie = np.flatnonzero(first[mid] == first[live])
            if len(tie):
                a, b = mine[mid[tie]], mine[live[tie]]
                ext = common_extension(prefix, a, b, most)
                less = data[np.minimum(a + ext, end)] < data[np.minimum(b + ext, end)]
                before[tie] = np.where(ext >= most, ~left[live[tie]], less)  # equal ones of the left run go first
            low[live[before]] = mid[before] + 1
            high[live[~before]] = mid[~before]
            live = live[low[live] < high[live]]
        to = base + (r // 2) * 2 * run + (place - r * run) + (low - start)
        out = np.empty(n, dtype=np.int64)
        out[to] = order
        order = out
        run *= 2
    return order


def _resolve(contents: list[bytes], group: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    lengths = np.fromiter(map(len, contents), dtype=np.int64, count=len(contents))
    data = np.frombuffer(b"".join(contents), dtype=np.uint8)
    prefix = Prefix(BYTE[data])
    span = np.repeat(np.arange(len(n)), n)
    at = (np.cumsum(lengths) - lengths)[span] + np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
    of = group[span]
    classes = np.arange(len(span))
    # A suffix whose window's hash is alone in its bucket equals no other: it needs no sorting.
    hashes = prefix.slices(at, at + size)
    by_hash = np.lexsort((hashes, of))
    same = (hashes[by_hash][1:] == hashes[by_hash][:-1]) & (of[by_hash][1:] == of[by_hash][:-1])
    again = np.zeros(len(span), dtype=bool)
    again[by_hash[1:][same]] = True
    again[by_hash[:-1][same]] = True
    picked = np.flatnonzero(again)
    if not len(picked):
        return classes
    order, equal = verified(data, at, of, picked[suffix_sort(prefix, data, at[picked], of[picked], size)], size)
    lead = np.concatenate(([True], ~equal))
    classes[order] = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]
    return classes


def verified(data: np.ndarray, at: np.ndarray, group: np.ndarray, order: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The order, put right where bytes contradict it, and whether each suffix but the first equals its predecessor on `size` bytes."""
    a, b = order[:-1], order[1:]
    within = group[a] == group[b]
    equal, wrong, reach = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=bool), np.arange(size)
    for chunk in np.array_split(np.flatnonzero(within), max(1, len(a) // 20_000)):
        x, y = data[at[a[chunk]][:, None] + reach], data[at[b[chunk]][:, None] + reach]
        differ = x != y
        equal[chunk] = ~differ.any(axis=1)
        first = differ.argmax(axis=1)[:, None]
        wrong[chunk] = (np.take_along_axis(x, first, 1) > np.take_along_axis(y, first, 1))[:, 0]
    if not wrong.any():
        return order, equal
    for g in np.unique(group[a[wrong]]).tolist():
        places = np.flatnonzero(group[order] == g)
        order[places] = sorted(order[places].tolist(), key=lambda i: data[at[i] : at[i] + size].tobytes())
    return verified(data, at, group, order, size)


def _window_bytes(contents: list[bytes], span: np.ndarray, inner: np.ndarray, size: int) -> list[bytes]:
    return [contents[k][i : i + size] for k, i in zip(span.tolist(), inner.tolist())]


def _apply(size: int):
    def run(frames):
        for frame in frames:
            rows = []
            for key, text, ranges in zip(frame[KEY].tolist(), frame["__text"], frame["__ranges"]):
                data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                kept, removed, spans = data, 0, 0
                if ranges is not None and len(ranges):
                    gone = covered(ranges, len(data), size)
                    kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                    removed = int(gone.sum())
                    spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
                rows.append((key, len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(rows, columns=[KEY, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, sub: int = MINIMISER, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: UTF-8 can be cut inside a character).

    A byte goes when a string of `size` bytes that covers it also starts earlier: in a document of
    smaller id, or earlier in the same one. Null texts are empty; texts shorter than `size` lose nothing.
    Rows that repeat an id are ordered by text; rows with a null id come first. An empty table gives
    an empty result; other columns are ignored.
    """
    keyed = Keyed(docs, id_col, [F.col(text_col).alias("__text")], ["__text"])
    base = keyed.df.select(KEY, "__text").where(F.col(KEY).isNotNull())
    fixed = {"size": size}
    ranges = repeated_ranges(base, partial(_windows, size=size, sub=min(sub, size)), partial(_content, **fixed), partial(_resolve, **fixed), partial(_window_bytes, **fixed), first_stays=True, bucket=bucket, finer=partial(_windows, size=size, sub=max(min(sub, size), size * 4 // 5)))
    out = base.join(ranges, KEY, "left").mapInPandas(tidied(_apply(size)), "__key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return keyed.restore(out, {KEY: "doc_id"}).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
