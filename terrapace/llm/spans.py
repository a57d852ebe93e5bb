"""Repeated fixed-length windows of sequences, found through spans that share a minimiser.

A *span* is a run of consecutive windows of one document with one minimiser (the least hash of
the sub-windows within a window), so equal windows always lie in spans of equal minimiser:

1. every task turns its texts into spans (minimiser, hash of the span's content, document, first
   window, number of windows) and merges equal spans among its own;
2. spans meet by minimiser. A minimiser that occurs once ends here, which is most of the data. Equal
   spans are settled by minimiser and BLAKE2 digest (64 bits each); of a minimiser with unlike spans, one of each kind is asked for;
3. those spans' contents are cut from the documents, travel packed to the minimiser's bucket, and
   an exact `resolve` finds the windows that they share. Spans of a very common minimiser are cut again by a longer one (`finer`),
   whose buckets hold only what agrees on that; a bucket that is still large is decided in parts, and each part's distinct windows meet again by digest;
4. the windows found are gathered per document, as ranges.

Nothing is compared pairwise, and documents' texts are exchanged once (both joins use the same exchange).
Rows of equal spans that meet are bounded by the number of tasks that emit them; those of a minimiser with very many
unlike spans come to one task sorted and are decided in pieces of HOT rows, so its memory stays bounded (its time does not).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, batches, partitions, stored, tidied

#: Most windows of a span (more than one minimiser can hold, unless it comes again); most spans of a minimiser that one bucket resolves; rows merged in a task at a time; characters at a time.
MOST_WINDOWS = 128
BUCKET = 256
MERGE_ROWS = 1 << 18
CHARS = 1 << 20
#: Rows of one minimiser that are held before a piece of them is decided.
HOT = 200_000
#: Times BUCKET: rows of one bucket of the longer minimiser that are resolved at a time.
FINE = 64
#: Spans that are resolved together at least; each may hold MOST_WINDOWS windows, and each window takes about a hundred bytes.
RESOLVE_ROWS = 10_000

#: kind 0: a span; 1: one that stands for several equal ones of its task; 2: a copy that its task has settled.
#: 4 more: the minimiser enters the span's windows again, without which no window repeats within its span.
SPANS = "h long, s long, __key long, start int, n int, kind byte"
#: part and parts: the bucket's part and number of parts; kind 2: settled; 3: content wanted; 4: content wanted, all its windows are settled.
MET = "h long, part int, parts int, __key long, start int, n int, kind byte"
CUT = "h long, part int, parts int, __key long, start int, n int, kind byte, content binary"
#: kind 0: settled windows; 1: a distinct window of one part of a bucket.
RESOLVED = "digest binary, __key long, start int, n int, kind byte"

#: texts (UTF-8) -> (offset, minimiser of each window, whether its last sub-window has the minimiser, position of its first unit, digests of spans given as (first, after last) window, text of each window)
Windows = Callable[[list[bytes]], tuple]
#: contents, group of each, windows of each -> class of each window (equal windows of a group have one class), as positions of the windows
Resolve = Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]


def runs(least: np.ndarray, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of maximal runs of consecutive windows with one text and minimiser, of MOST_WINDOWS at most."""
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(least)))
    parts = -(-size // MOST_WINDOWS)
    if (parts > 1).any():
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + inner * MOST_WINDOWS
    return start, np.append(start[1:], len(least))


def _merged(rows: list[np.ndarray], first_stays: bool) -> pd.DataFrame:
    h, s, key, start, n, twice = (np.concatenate(x) for x in zip(*rows))
    both = h ^ (s * np.int64(0x2545F4914F6CDD1D))
    order = np.lexsort((start, key, both))
    h, s, key, start, n, twice = (x[order] for x in (h, s, key, start, n, twice))
    again = np.concatenate(([False], (h[1:] == h[:-1]) & (s[1:] == s[:-1])))
    kind = np.where(again, 2, 0).astype(np.int8)
    lead = np.flatnonzero(~again)
    kind[lead[np.append(again[1:], False)[lead]]] = 1
    kind[~again & twice] += 4
    h = np.where(again, key * np.int64(0x9E3779B97F4A7C1) + start, h)
    return pd.DataFrame({"h": h, "s": s, KEY: key, "start": start.astype(np.int32), "n": n.astype(np.int32), "kind": kind})


def _emit(windows: Windows, first_stays: bool):
    def run(frames):
        rows, held = [], 0
        for group in batches(frames, "__text", CHARS):
            texts, keys = [], []
            for frame in group:
                texts += [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in frame["__text"]]
                keys += frame[KEY].tolist()
            for offsets, least, enters, at, span_digest, text in windows(texts):
                start, stop = runs(least, text, at)
                if not len(start):
                    continue
                s = span_digest(start, stop)
                key = np.array(keys, dtype=np.int64)[text[start]]
                entered = np.cumsum(enters)
                rows.append((least[start].view(np.int64), s, key, at[start] + offsets, stop - start, entered[stop - 1] > entered[start]))
                held += len(start)
                if held >= MERGE_ROWS:
                    yield _merged(rows, first_stays)
                    rows, held = [], 0
        if rows:
            yield _merged(rows, first_stays)

    return run


def _groups(frames, columns: list[str], least: int = 50_000) -> Iterator[pd.DataFrame]:
    """Batches regrouped of `least` rows or more, so that rows with equal columns (by which they are sorted) are never in two."""
    held: list[pd.DataFrame] = []
    rows = 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        rows += len(frame)
        if rows < least:
            continue
        whole = pd.concat(held, ignore_index=True)
        last = np.ones(len(whole), dtype=bool)
        for c in columns:
            last &= (whole[c] == whole[c].iloc[-1]).to_numpy()
        cut = len(whole) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield whole.iloc[:cut]
        held, rows = [whole.iloc[cut:]], 0
    if held and (whole := pd.concat(held, ignore_index=True)) is not None and len(whole):
        yield whole


def _meet(first_stays: bool, bucket: int):
    columns = ["h", "part", "parts", KEY, "start", "n", "kind"]

    def decide(frame, hot, ranked):
        """Rows sorted by minimiser, digest, document and start; of `hot`, `ranked` kinds have been decided before."""
        h, s, key, start, n, kind = (frame[c].to_numpy() for c in ("h", "s", KEY, "start", "n", "kind"))
        done = kind == 2
        out = [(h[done], key[done], start[done], n[done], np.full(done.sum(), 2, np.int8), np.zeros(done.sum(), np.int64), np.ones(done.sum(), np.int64))]
        h, s, key, start, n, kind = (x[~done] for x in (h, s, key, start, n, kind))
        if len(h):
            new_h = np.concatenate(([True], h[1:] != h[:-1]))
            new_s = new_h | np.concatenate(([True], s[1:] != s[:-1]))
            sub = np.cumsum(new_s) - 1
            count = np.bincount(sub) + np.bincount(sub, weights=kind % 4 == 1).astype(np.int64)
            of_h = np.cumsum(new_h) - 1
            kinds = np.bincount(of_h, weights=new_s).astype(np.int64)[of_h]
            rank = sub - sub[np.flatnonzero(new_h)][of_h]
            if hot is not None:
                kinds = np.where(h == hot, np.maximum(kinds, bucket + 1), kinds)
                rank = np.where(h == hot, rank + ranked, rank)
            repeated = count[sub] > 1
            settled = ~new_s if first_stays else repeated
            out.append((h[settled], key[settled], start[settled], n[settled], np.full(settled.sum(), 2, np.int8), np.zeros(settled.sum(), np.int64), np.ones(settled.sum(), np.int64)))
            ask = new_s & ((kinds > 1) | (kind >= 4))
            whole = repeated[ask] & (not first_stays)
            out.append((h[ask], key[ask], start[ask], n[ask], np.where(whole, 4, 3).astype(np.int8), rank[ask] // bucket, -(-kinds[ask] // bucket)))
        h, key, start, n, kind, part, parts = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"h": h, "part": part.astype(np.int32), "parts": parts.astype(np.int32), KEY: key, "start": start, "n": n, "kind": kind})[columns]

    def run(frames):
        held, hot, ranked = [], None, 0
        for frame in _groups(frames, ["h", "s"]):
            held.append(frame)
            rows = pd.concat(held, ignore_index=True)
            h = rows["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield decide(rows.iloc[:cut], hot, ranked)
            held = [rows.iloc[cut:]]
            if len(held[0]) > HOT:
                hot, ranked = int(h[-1]), ranked if hot == h[-1] else 0
                yield decide(held[0], hot, ranked)
                ranked += held[0]["s"].nunique()
                held = []
        if held:
            yield decide(held[0], hot, ranked)

    return run


def _cut(content: Callable, finer: Windows | None):
    columns = [c.split()[0] for c in CUT.split(", ")]

    def again(rows: list[tuple]) -> Iterator[tuple]:
        """Spans of very common minimisers, cut where the longer minimiser changes."""
        for offset, least, _, at, _, text in finer([r[-1] for r in rows]):
            start, stop = runs(least, text, at)
            for h, k, i, n in zip(least[start].view(np.int64).tolist(), text[start].tolist(), (at[start] + offset).tolist(), (stop - start).tolist()):
                _, _, _, key, first, most, kind, data = rows[k]
                yield h, 0, 1, key, first + i, n, kind, data[i : len(data) - (most - i - n)]

    def frame(rows):
        common = [r for r in rows if r[2] > 1] if finer else []
        return pd.DataFrame([r for r in rows if r[2] == 1] + list(again(common)) if common else rows, columns=columns)

    def run(frames):
        for texts in frames:
            out = []
            for key, text, wanted in zip(texts[KEY].tolist(), texts["__text"], texts["__wanted"]):
                data = content(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"")
                out += [(w["h"], w["part"], w["parts"], key, w["start"], w["n"], w["kind"], data(w["start"], w["n"])) for w in wanted]
                if len(out) > 20_000:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    return run


def _pieces(frames, most: int) -> Iterator[pd.DataFrame]:
    """As _groups() by bucket and part; groups of over `most` rows come in pieces, with 2 parts or more."""
    held, large = [], None
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        if sum(map(len, held)) < min(RESOLVE_ROWS, most):
            continue
        rows = pd.concat(held, ignore_index=True)
        h, part = rows["h"].to_numpy(), rows["part"].to_numpy()
        other = np.flatnonzero((h != h[-1]) | (part != part[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if len(rows) - cut > most:
            if cut:
                yield _marked(rows.iloc[:cut], large)
            large = int(h[-1]), int(part[-1])
            yield _marked(rows.iloc[cut:], large)
            held = []
        else:
            if cut:
                yield _marked(rows.iloc[:cut], large)
            held = [rows.iloc[cut:]]
    if held:
        yield _marked(pd.concat(held, ignore_index=True), large)


def _marked(rows: pd.DataFrame, large: tuple[int, int] | None) -> pd.DataFrame:
    if large is None:
        return rows
    mine = ((rows["h"] == large[0]) & (rows["part"] == large[1])).to_numpy()
    return rows.assign(parts=np.where(mine, np.maximum(rows["parts"].to_numpy(), 2), rows["parts"].to_numpy()))


def _resolve(resolve: Resolve, window_bytes: Callable, first_stays: bool, most: int):
    def run(frames):
        for frame in _pieces(frames, most):
            contents = frame["content"].tolist()
            n, key, start, kind, parts = (frame[c].to_numpy() for c in ("n", KEY, "start", "kind", "parts"))
            new = np.concatenate(([True], (frame["h"].to_numpy()[1:] != frame["h"].to_numpy()[:-1]) | (frame["part"].to_numpy()[1:] != frame["part"].to_numpy()[:-1])))
            group = np.cumsum(new) - 1
            classes = resolve(contents, group, n)
            span = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((start[span] + inner, key[span], classes))
            first = np.zeros(len(span), dtype=bool)
            if len(span):
                first[order[np.concatenate(([True], classes[order][1:] != classes[order][:-1]))]] = True
            count = np.bincount(classes)[classes] if len(span) else np.zeros(0, np.int64)
            settled = ~first if first_stays else count > 1
            out = []
            marked = settled & ((kind != 4)[span])
            # ranges of marked windows within a span
            edge = np.concatenate(([True], (span[1:] != span[:-1]) | (marked[1:] != marked[:-1])))
            at = np.flatnonzero(edge)
            size = np.diff(np.append(at, len(span)))
            keep = marked[at]
            at, size = at[keep], size[keep]
            k, p = key[span[at]], start[span[at]] + inner[at]
            if len(at):
                out.append(pd.DataFrame({"digest": [int(a).to_bytes(8, "little", signed=True) + int(b).to_bytes(8, "little") for a, b in zip(k, p)], KEY: k, "start": p.astype(np.int32), "n": size.astype(np.int32), "kind": np.int8(0)}))
            more = np.flatnonzero(first & (parts[span] > 1))
            if len(more):
                digest = [hashlib.blake2b(w, digest_size=16).digest() for w in window_bytes(contents, span[more], inner[more])]
                out.append(pd.DataFrame({"digest": digest, KEY: key[span[more]], "start": (start[span[more]] + inner[more]).astype(np.int32), "n": np.int32(1), "kind": np.int8(1)}))
            yield from out

    return run


def repeated_ranges(keyed: DataFrame, windows: Windows, content: Callable, resolve: Resolve, window_bytes: Callable, first_stays: bool, bucket: int = BUCKET, finer: Windows | None = None) -> DataFrame:
    """(KEY, __ranges: array of (start, n)): windows start .. start + n - 1 of a document that are repeated.

    With first_stays, a window's first occurrence (by key, then start) is not among them. Documents
    without repeated windows have no row. finer: as windows, on contents and by longer sub-windows; spans of minimisers
    with more than `bucket` kinds are cut by it.
    """
    n = partitions(keyed)
    spans = keyed.select(KEY, "__text").mapInPandas(tidied(_emit(windows, first_stays)), SPANS)
    met = stored(spans.repartition(n, "h").sortWithinPartitions("h", "s", KEY, "start").mapInPandas(tidied(_meet(first_stays, bucket)), MET), "met")
    wanted = met.where("kind >= 3").groupBy(KEY).agg(F.collect_list(F.struct("h", "part", "parts", "start", "n", "kind")).alias("__wanted"))
    cut = keyed.select(KEY, "__text").join(wanted, KEY).mapInPandas(tidied(_cut(content, finer)), CUT)
    resolved = cut.repartition(n, "h", "part").sortWithinPartitions("h", "part").mapInPandas(tidied(_resolve(resolve, window_bytes, first_stays, FINE * bucket)), RESOLVED)
    again = F.expr("row_number() over (partition by digest order by __key, start) > 1") if first_stays else F.expr("count(*) over (partition by digest) > 1")
    resolved = resolved.withColumn("again", again).where("kind = 0 or again")
    settled = met.where("kind = 2").select(KEY, "start", "n").union(resolved.select(KEY, "start", "n"))
    return settled.groupBy(KEY).agg(F.collect_list(F.struct("start", "n")).alias("__ranges"))


def covered(ranges, length: int, size: int) -> np.ndarray:
    """Of `length` units, those that a window of `size` units of the ranges covers."""
    step = np.zeros(length + 1, dtype=np.int32)
    if ranges is not None and len(ranges):
        start = np.fromiter((r["start"] for r in ranges), dtype=np.int64)
        n = np.fromiter((r["n"] for r in ranges), dtype=np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, np.minimum(start + n - 1 + size, length), -1)
    return np.cumsum(step[:-1]) > 0
