"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to context tiers (powers of two up to the longest) by what is left of them
after full sequences are cut off. Each tier, the longest first, is packed into windows of its own length; gaps are filled
from the shorter tiers, the longest piece that fits first, and the last piece that goes in is cut. What a pool of documents leaves
over is cut into power-of-two sequences, so no sequence needs padding. Sequences are dealt to step
groups of even attention cost.

Pools are packed where their texts were read: tokens never shuffle, a pool's memory is bounded
(POOL_TOKENS and one document), and a lost task is redone alone.
"""

from __future__ import annotations

import heapq
import os
from bisect import bisect_left, insort
from itertools import chain, repeat

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, batches, give_back, small_batches

LONGEST = 4096
#: Tokens packed together at a time; and the sequences of one step group.
POOL_TOKENS = 2 << 20
STEP = 16
END = 2
#: Signs that, after letters, are a pre-token of their own.
SIGNS = b".,;:!?#$%&*"
#: Words whose ids a worker remembers.
MOST_WORDS = 1 << 19
#: Characters and new words that are tokenised together: what the tokenizer returns takes over a hundred bytes a token.
CHARS, NEW_WORDS = 256 << 10, 4096

PIECES = "__key long, __no_key boolean, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, tier long, step_group long, ids binary"


class WordTokenizer:
    """The ids of texts by a tokenizer that never joins characters across ASCII white space.

    Each distinct word is tokenised once per worker; texts are then put together from an index.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.start, self.size, self.used = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64), 0

    def add(self, words: list[bytes]) -> None:
        """Remembers the ids of new words.

        Letters are one pre-token, as is a run of signs after them, so words of that form are
        tokenised in one go and cut where pre-tokens end; all others are tokenised one by one.
        """
        plain, parts, other = [], [], []
        for word in words:
            stem = word.rstrip(SIGNS)
            if stem.isalpha() or stem.decode("utf-8", "surrogatepass").lower().isalpha():
                plain.append(word)
                parts.append(1 if len(stem) == len(word) else 2)
            else:
                other.append(word)
        text = b" ".join(plain).decode("utf-8", "surrogatepass")
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        cuts, last = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(np.array(parts, dtype=np.int64))
        if len(cuts) == (last[-1] if len(last) else 0) and (not len(ids) or cuts[-1] == len(ids)):
            self._store(plain, ids, cuts[last - 1] if len(last) else last)
        else:
            other += plain
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in other], add_special_tokens=False)]
        self._store(other, np.fromiter(chain.from_iterable(found), dtype=np.uint32), np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found))))

    def _store(self, words: list[bytes], ids: np.ndarray, stop: np.ndarray) -> None:
        first, n = len(self.index), len(words)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(2 * len(ids) + self.used, dtype=np.uint32)))
        if first + n > len(self.start):
            self.start, self.size = (np.concatenate((x[:first], np.zeros(2 * n + first, dtype=np.int64))) for x in (self.start, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        start = np.concatenate(([0], stop[:-1])) if n else stop
        self.start[first : first + n] = self.used + start
        self.size[first : first + n] = stop - start
        self.used += len(ids)
        self.index.update(zip(words, range(first, first + n)))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        if not texts:
            return []
        # The tokenizer lower-cases; only its special tokens, which all have <|, are found before that.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.index) > MOST_WORDS or self.used > 16 * MOST_WORDS:
            self.clear()
        n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            fresh = list(dict.fromkeys([words[i] for i in new]))
            for k in range(0, len(fresh), NEW_WORDS):
                self.add(fresh[k : k + NEW_WORDS])
            at[new] = [self.index[words[i]] for i in new]
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        pick = np.repeat(self.start[at] - (ends - size), size) + np.arange(total)
        cuts = np.concatenate(([0], ends))[np.cumsum(n)]
        return np.split(self.ids[pick], cuts[:-1])


def tier_of(n: int, longest: int = LONGEST) -> int:
    """The shortest context (a power of two, 1/16 of the longest at least) that holds n tokens."""
    tier = longest // 16
    while tier < n:
        tier *= 2
    return min(tier, longest)


def pack_pool(lengths: list[int], longest: int = LONGEST) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences of one pool: (length, [(document's place, start, pieces' length)]).

    Every token of every document is in exactly one piece. Lengths are `longest`, or powers of two.
    """
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    tiers: dict[int, list[tuple[int, int, int]]] = {}  # pieces as (length, place, start), ascending

    def route(piece: tuple[int, int, int]) -> None:
        insort(tiers.setdefault(tier_of(piece[0], longest), []), piece)

    def take(tier: int, at: int) -> tuple[int, int, int]:
        piece = tiers[tier].pop(at)
        if not tiers[tier]:
            del tiers[tier]
        return piece

    def longest_within(gap: int) -> tuple[int, int, int] | None:
        for tier in sorted(tiers, reverse=True):
            at = bisect_left(tiers[tier], (gap + 1,)) - 1
            if at >= 0:
                return take(tier, at)
        return None

    def shortest_above(gap: int) -> tuple[int, int, int] | None:
        for tier in sorted(tiers):
            at = bisect_left(tiers[tier], (gap + 1,))
            if at < len(tiers[tier]):
                return take(tier, at)
        return None

    for k, n in enumerate(lengths):
        at = 0
        while n - at >= longest:
            out.append((longest, [(k, at, longest)]))
            at += longest
        if n > at:
            tiers.setdefault(tier_of(n - at, longest), []).append((n - at, k, at))
    for pieces in tiers.values():
        pieces.sort()
    rest: list[tuple[int, int, int]] = []
    while tiers:
        tier = max(tiers)
        window, gap = [take(tier, -1)], tier
        gap -= window[0][0]
        while gap:
            piece = longest_within(gap)
            if piece is None:
                piece = shortest_above(gap)
                if piece is None:
                    break
                n, k, at = piece
                route((n - gap, k, at + gap))
                piece = (gap, k, at)
            window.append(piece)
            gap -= piece[0]
        pieces = [(k, at, n) for n, k, at in window]
        if gap:  # nothing is left to fill the last window
            rest = pieces
        else:
            out.append((tier, pieces))
    total = sum(p[2] for p in rest)
    rest.reverse()
    while total:
        size = min(longest, 1 << (total.bit_length() - 1))
        window, room = [], size
        while room:
            k, at, n = rest.pop()
            take = min(n, room)
            window.append((k, at, take))
            room -= take
            if take < n:
                rest.append((k, at + take, n - take))
        out.append((size, window))
        total -= size
    return out


def step_groups(lengths: list[int], each: int = STEP) -> list[int]:
    """A step group for each sequence: as many groups as needed for `each` sequences, the costliest first to the group with the least cost that has room."""
    groups = -(-len(lengths) // each)
    heap = [(0, g, 0) for g in range(groups)]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        cost, g, n = heapq.heappop(heap)
        out[i] = g
        if n + 1 < each:
            heapq.heappush(heap, (cost + lengths[i] ** 2, g, n + 1))
    return out


def _rows(keys: list[tuple[int, bool]], ids: list[np.ndarray], part: int, pool: int, longest: int) -> pd.DataFrame:
    sequences = pack_pool([len(x) for x in ids], longest)
    steps = step_groups([n for n, _ in sequences])
    rows = []
    base = (part << 38) | (pool << 24)
    for s, ((size, window), step) in enumerate(zip(sequences, steps)):
        offset = 0
        for k, at, n in window:
            rows.append((*keys[k], at, n, len(ids[k]), base | s, offset, size, tier_of(len(ids[k]), longest), base | step, ids[k][at : at + n].astype("<u4").tobytes()))
            offset += n
    return pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])


def packer(path: str, longest: int, end: int, pool_tokens: int):
    def pieces(frames, encode):
        part, pool, keys, ids, held = TaskContext.get().partitionId(), 0, [], [], 0
        for group in batches(frames, "__text", CHARS):
            for frame in group:
                texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in frame["__text"]]
                for key, no_key, x in zip(frame[KEY].tolist(), frame["__no_key"].tolist(), encode(texts)):
                    keys.append((key, no_key))
                    ids.append(np.append(x, np.uint32(end)))
                    held += len(x) + 1
                    if held >= pool_tokens:
                        yield _rows(keys, ids, part, pool, longest)
                        pool, keys, ids, held = pool + 1, [], [], 0
                        give_back()
        if keys:
            yield _rows(keys, ids, part, pool, longest)

    def run(frames):
        # Remembered words go with the task, as Spark keeps the worker for later stages.
        yield from pieces(frames, WordTokenizer(path).encode)
        give_back()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, longest: int = LONGEST, end: int = END, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, sequence_length, tier, step_group, ids.

    A document's tokens are the tokenizer's ids of its text (null: none), then `end`; so an empty
    text gives one piece of one token. ids holds the piece's tokens, little-endian unsigned 32-bit.
    Very long documents span several sequences. Repeated rows and rows with a null id are packed
    each for itself. An empty table gives no pieces. Other columns are ignored. sequence_id
    depends on how the input is split into tasks.
    """
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    small_batches(docs.sparkSession)
    key = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(key, F.lit(0)).cast("long").alias(KEY), key.isNull().alias("__no_key"), F.col(text_col).alias("__text"))
    pieces = rows.mapInPandas(packer(path, longest, end, pool_tokens), PIECES)
    columns = [x.split()[0] for x in PIECES.split(", ")][2:]
    return pieces.select(F.when(~F.col("__no_key"), F.col(KEY)).alias("doc_id"), *columns)
