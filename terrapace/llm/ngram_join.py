"""Similarity join on word n-grams: a blocked sparse product of documents by n-grams.

The product of the document by n-gram incidence matrix with its transpose counts common n-grams.
It is computed only for blocks that can hold a pair:

1. Each set is cut into parts by its n-grams' hashes, a few more parts than the most n-grams on
   which two linked sets of these sizes can differ, so that linked sets agree on a whole part.
   Parts meet by hash and give candidate edges; equal sets are linked at once. A task first merges
   what it has twice, so a part or set of any number of documents stays a few rows for each task.
2. Components of the candidate edges, of one size level each, are the diagonal blocks. In a component of more than HOT
   blocks, members are first compared with one representative; those linked to it are one class, of which no pair needs a look.
3. Pairs in which one member at least is in no class are dealt to groups of two blocks of BLOCK documents, so a component of near
   copies of one text is dealt in proportion to its size. A first pass over parity sketches (two sets differ on at least as many members as their
   sketches on bits) splits components that only shared boilerplate holds together.
4. In what is left, overlap counts are accumulated: n-grams of few holders by their pairs, those of many by dense slices.
   Pairs are discarded by size before, as soon as what is left of their sets can't make the overlap they need, and by overlap after.
5. A spanning forest of each group's links, the links to representatives and those of equal sets give the components.

Equal sets are those that agree in a BLAKE2 digest of their n-grams (64 bits), size and parity sketch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, Keyed, Prefix, Words, batches, components, digests, encoded, join_heavy, mix, partitions, stored, tidied
from .exact_dedup import possible_members
from .spans import CHARS, MERGE_ROWS, _groups

GRAM = 4
#: Documents of a block, and n-grams of one slice of the product.
BLOCK = 128
#: Documents of a block where only sketches are compared.
SKETCH_BLOCK = 1024
SLICE = 4096
#: Blocks of a component beyond which its members are first compared with a representative; holders up to which an n-gram's pairs are listed.
HOT = 4
SPARSE = 8
#: kind 0: a part's hash and the node that has it (a document at a size level); 1: a candidate edge between nodes; 2: a set's hash, with its size; 3: a copy of an equal set, with its size.
PARTS = "h long, __key long, peer long, n int, kind byte, sketch binary"


def gram_sets(texts: list[bytes], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, ordered by (text, hash), and each text's range of them."""
    words = Words(texts, lower=True)
    n = words.last - words.first
    prefix = Prefix(words.hash)
    counts = np.where(n >= gram, n - gram + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), counts)
    start = words.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.minimum(n[owner], gram)
    grams = mix(prefix.slices(start, start + size) + size.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    return grams[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def size_levels(percent: int, most: int) -> np.ndarray:
    """Lower ends of size levels: linked sets are in one level or in neighbouring ones."""
    ends = [1]
    while ends[-1] <= most:
        ends.append(ends[-1] * 100 // percent + 1)
    return np.array(ends, dtype=np.int64)


def part_hashes(grams: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the parts of each set for its own size level and the next, the set of each, and 0 or 1 for the level.

    Sets of at most u members that are linked differ on at most d = 2u(100 - p)/(100 + p) of them,
    so with over d parts one part is equal. It could be a tiny one (empty, or of one member in larger
    sets), which unlike sets share easily; there are spare parts for those, and only sets with more of them also emit them.
    """
    n = np.diff(at)
    ends = size_levels(percent, int(n.max(initial=1)) * 100 // percent + 1)
    hashes, owners, steps = [], [], []
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(grams))))
    of = np.repeat(np.arange(len(n)), np.diff(at))
    for step in (0, 1):
        level = np.searchsorted(ends, n, side="right") - 1 + step
        most = ends[np.minimum(level + 1, len(ends) - 1)] - 1
        differ = 2 * most * (100 - percent) // (100 + percent)
        # Parts of one member count as tiny too, where sets of this level can spare as many as they are likely to have.
        size = most * (percent / 100) ** 1.5
        m = 1.17 * differ + 4
        spare = 3 + differ // 6
        large = 1.2 * m * np.exp(-size / m) * (1 + size / m) + 1 <= spare
        m = 1.1 * differ + 2
        spare = np.where(large, spare, 1 + np.ceil(1.5 * m * np.exp(-size / m)).astype(np.int64))
        parts = np.where(differ > 0, differ + 1 + spare, 0)
        use = parts[of] > 0
        g, o = np.flatnonzero(use), of[use]
        part = ((grams[g] >> np.uint64(32)) * parts[o].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(g), dtype=bool)
        new[1:] = (o[1:] != o[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        stop = np.append(first[1:], len(g)) if len(first) else first
        name = mix((level[o[first]].astype(np.uint64) << np.uint64(32)) | part[first])
        value = mix((total[g[stop - 1] + 1] - total[g[first]]) ^ name)
        holder, whole = o[first], stop - first >= np.where(large, 2, 1)[o[first]]
        unsafe = parts - np.bincount(holder[whole], minlength=len(n)) > spare
        keep = whole | unsafe[holder]
        hashes.append(value[keep])
        owners.append(holder[keep])
        for k in np.flatnonzero(unsafe).tolist():
            a, b = np.searchsorted(holder, (k, k + 1))
            empty = np.setdiff1d(np.arange(parts[k], dtype=np.uint64), part[first[a:b]])
            hashes.append(mix(mix((np.uint64(level[k]) << np.uint64(32)) | empty) + np.uint64(1)))
            owners.append(np.full(len(empty), k))
        steps.append(np.full(sum(map(len, owners)) - sum(map(len, steps)), step))
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(owners), np.concatenate(steps)


#: Least bits of a sketch (the parity of a set's members in each of so many bins); larger sets have as many as members, rounded up to a power of two.
SKETCH_BITS = 2048


def sketches(grams: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Two sets differ on at least as many members as their sketches, folded to one length, differ on bits."""
    n = np.diff(at)
    bits = np.maximum(SKETCH_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    start = np.cumsum(bits) - bits
    of = np.repeat(np.arange(len(n)), n)
    place = start[of] + (mix(grams) & (bits[of] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=int(bits.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8))
    return [packed[a : a + b].tobytes() for a, b in zip((start // 8).tolist(), (bits // 8).tolist())]


def folded(sketch: bytes, words: int) -> np.ndarray:
    """A sketch as `words` 64-bit words: halves are laid over each other."""
    out = np.frombuffer(sketch, dtype=np.uint64)
    while len(out) > words:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _frame(h, key, peer, n, kind, sketch=None) -> pd.DataFrame:
    return pd.DataFrame({"h": h, KEY: key, "peer": peer, "n": n, "kind": kind, "sketch": sketch})


def _first_of(h: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (h, key); and for each place in it whether it is the first with its h, and the key of that first."""
    order = np.lexsort((key, h))
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[order][1:] != h[order][:-1]
    lead = key[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else key
    return order, new, lead


def _spread(key: np.ndarray) -> np.ndarray:
    return mix(key.view(np.uint64)).view(np.int64)


def _emit(gram: int, percent: int):
    def run(frames):
        rows, held, known = [], 0, {}

        def merged():
            h, key = (np.concatenate(x) for x in zip(*rows))
            order, new, lead = _first_of(h, key)
            h, key = h[order], key[order]
            pairs = np.unique(np.stack((key[~new], lead[~new])), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            return pd.concat((_frame(h[new], key[new], np.int64(0), np.int32(0), np.int8(0)), _frame(_spread(pairs[0]), pairs[0], pairs[1], np.int32(0), np.int8(1))))

        for group in batches(frames, "__text", CHARS):
            texts, keys = [], []
            for frame in group:
                texts += [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in frame["__text"]]
                keys += frame[KEY].tolist()
            grams, at = gram_sets(texts, gram)
            key, n = np.array(keys, dtype=np.int64), np.diff(at)
            sets = digests(grams.tobytes(), 8 * at[:-1], 8 * at[1:])
            lead = np.array([known.setdefault(s, k) if m else k for s, k, m in zip(sets.tolist(), keys, n.tolist())], dtype=np.int64)
            if len(known) > MERGE_ROWS:
                known.clear()
            alone = lead == key
            yield _frame(np.where(alone & (n > 0), sets, _spread(key)), key, lead, n.astype(np.int32), np.where(alone, 2, 3).astype(np.int8), sketches(grams, at))
            hashes, owner, step = part_hashes(grams, at, percent)
            own = alone[owner]
            rows.append((hashes[own].view(np.int64), (key[owner[own]] << 1) + step[own]))
            held += int(own.sum())
            if held >= MERGE_ROWS:
                yield merged()
                rows, held = [], 0
        if rows:
            yield merged()

    return run


def _meet(frames):
    """kind 1: candidate edges; 2: the first of a set; 3: its copies, linked to peer."""
    for frame in _groups(frames, ["h"]):
        h, key, peer, n, kind = (frame[c].to_numpy() for c in ("h", KEY, "peer", "n", "kind"))
        done = (kind == 1) | (kind == 3)
        out = [frame[done]]
        part = kind == 0
        order, new, lead = _first_of(h[part], key[part])
        k = key[part][order]
        pairs = np.unique(np.stack((k[~new], lead[~new])), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        out.append(_frame(np.int64(0), pairs[0], pairs[1], np.int32(0), np.int8(1)))
        part = kind == 2
        sketch = frame["sketch"].to_numpy()[part]
        order, new, lead = _first_of(h[part], key[part])
        size, sketch, first = n[part][order], sketch[order], np.flatnonzero(new)[np.cumsum(new) - 1]
        own = new | (size == 0) | (size != size[first]) | np.array([x != y for x, y in zip(sketch, sketch[first])], dtype=bool)
        out.append(_frame(h[part][order], key[part][order], np.where(own, key[part][order], lead), size, np.where(own, 2, 3).astype(np.int8), np.where(own, sketch, None)))
        yield pd.concat(out)[["h", KEY, "peer", "n", "kind", "sketch"]]


def _pairs(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Each row once for every pair of blocks that it is needed in: the row, and the pair's number.

    Of a component's `open` blocks (of members in no class) all pairs are needed, of its `fixed_blocks` those with an open one.
    """
    keys, fixed, open_, others = (frame[c].to_numpy() for c in (KEY, "fixed", "open", "fixed_blocks"))
    open_, others = open_.astype(np.int64), others.astype(np.int64)
    mine = (mix(keys.astype(np.int64).view(np.uint64)) % np.where(fixed, others, open_).astype(np.uint64)).astype(np.int64)
    copies = np.where(fixed, open_, open_ + others)
    row = np.repeat(np.arange(len(keys)), copies)
    other = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
    mine, fixed, open_, others = mine[row], fixed[row], open_[row], others[row]
    among = np.minimum(mine, other) * open_ + np.maximum(mine, other)
    across = open_ * open_ + np.where(fixed, other * others + mine, mine * others + other - open_)
    return row, np.where(~fixed & (other < open_), among, across)


def _deal(frames):
    for frame in frames:
        row, pair = _pairs(frame)
        for at in range(0, len(row), 8192):
            yield frame.iloc[row[at : at + 8192]].assign(pair=pair[at : at + 8192])[["comp", "pair", KEY, "n", "fixed", "sketch"]]


def _forest(keys: list[int], linked: np.ndarray, fixed: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a matrix of links; the fixed ones are joined already."""
    root = list(range(len(keys)))
    first = int(fixed.argmax())

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in np.flatnonzero(fixed).tolist():
        root[k] = first
    out = []
    for a, b in np.argwhere(np.triu(linked, 1)).tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            out.append((keys[a], keys[b]))
    return out


def sketch_forest(keys: list[int], n: np.ndarray, bits: np.ndarray, percent: int, fixed: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that may be linked by their sketches; a row of comparisons at a time. The fixed ones are joined already."""
    part, out = np.where(fixed, -1, np.arange(len(keys))), []
    for i in np.flatnonzero(~fixed).tolist():
        differ = np.bitwise_count(bits ^ bits[i]).sum(axis=1, dtype=np.int64)
        may = ((100 + percent) * differ <= (100 - percent) * (n + n[i])) & (part != part[i])
        for j in np.flatnonzero(may).tolist():
            if part[j] != part[i]:
                out.append((keys[i], keys[j]))
                part[part == part[j]] = part[i]
    return out


def _prune(percent: int):
    def run(frames):
        for frame in _groups(frames, ["comp", "pair"], 8_000):
            out = []
            for _, group in frame.groupby(["comp", "pair"], sort=False):
                if len(group) > 1:
                    words = min(map(len, group["sketch"])) // 8
                    bits = np.stack([folded(x, words) for x in group["sketch"]])
                    out += sketch_forest(group[KEY].tolist(), group["n"].to_numpy(np.int64), bits, percent, group["fixed"].to_numpy(bool))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def _sets(gram: int, deal):
    """Rows with the n-grams of their texts, for every pair that deal(frame) names."""
    names = ["comp", "pair", KEY, "fixed", "grams"]

    def run(frames):
        for group in batches(frames, "__text", CHARS):
            frame = pd.concat(group)
            grams, at = gram_sets(encoded(frame["__text"]), gram)
            keys, comps, fixed = frame[KEY].tolist(), frame["comp"].tolist(), frame["fixed"].tolist()
            out, held = [], 0
            for k, pair in zip(*(x.tolist() for x in deal(frame))):
                data = grams[at[k] : at[k + 1]].tobytes()
                out.append((comps[k], pair, keys[k], fixed[k], data))
                held += len(data)
                if held > 8 << 20:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    return run


def _salts(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A representative (fixed) goes to every salt of its component, a member to one."""
    keys, fixed, salts = frame[KEY].to_numpy(np.int64), frame["fixed"].to_numpy(bool), frame["salts"].to_numpy(np.int64)
    copies = np.where(fixed, salts, 1)
    row = np.repeat(np.arange(len(keys)), copies)
    other = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
    mine = (mix(keys.view(np.uint64)) % salts.astype(np.uint64)).astype(np.int64)
    return row, np.where(fixed[row], other, mine[row])


def _star(percent: int):
    """(comp, a, b): members a linked to their component's representative b."""

    def run(frames):
        for frame in _groups(frames, ["comp", "pair"], 2_000):
            out = []
            for (comp, _), group in frame.groupby(["comp", "pair"], sort=False):
                fixed = group["fixed"].to_numpy(bool)
                if not fixed.any():
                    continue
                lead, key = int(group[KEY].iloc[fixed.argmax()]), group[KEY].tolist()
                sets = [np.frombuffer(g, dtype=np.uint64) for g in group["grams"]]
                one = sets[fixed.argmax()]
                for k, other in zip(key, sets):
                    place = np.minimum(np.searchsorted(one, other), len(one) - 1)
                    common = int((one[place] == other).sum())
                    if k != lead and 100 * common >= percent * (len(one) + len(other) - common):
                        out.append((comp, k, lead))
            yield pd.DataFrame(out, columns=["comp", "a", "b"], dtype=np.int64)

    return run


def overlaps(sets: list[np.ndarray], possible: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of common members of pairs of sets, and which of the possible pairs are left.

    The incidence matrix is taken by columns that two sets or more share. Columns of few holders add one to each of their pairs; those
    of many are multiplied in dense slices. A pair goes once the columns left can't lift it to the overlap it needs; what is
    counted of pairs that are not left is not complete.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    need = -(-percent * (size[:, None] + size[None, :]) // (100 + percent))
    _, column, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    shared = holders[column] > 1
    row, column = row[shared], column[shared]
    order = np.lexsort((column, holders[column]))
    row, column = row[order], column[order]
    common, left = np.zeros(m * m, dtype=np.int64), np.bincount(row, minlength=m)
    ends = np.searchsorted(holders[column], np.arange(SPARSE + 2))
    for c in range(2, SPARSE + 1):
        group = row[ends[c] : ends[c + 1]].reshape(-1, c)
        for i in range(c):
            for j in range(i + 1, c):
                common += np.bincount(group[:, i] * m + group[:, j], minlength=m * m)
    common = common.reshape(m, m)
    common += common.T
    left -= np.bincount(row[: ends[SPARSE + 1]], minlength=m)
    row, column = row[ends[SPARSE + 1] :], column[ends[SPARSE + 1] :]
    new = np.ones(len(column), dtype=bool)
    new[1:] = column[1:] != column[:-1]
    column = np.cumsum(new) - 1
    possible = possible & (common + np.minimum(left[:, None], left[None, :]) >= need)
    for first in range(0, int(new.sum()), SLICE):
        if not possible.any():
            break
        a, b = np.searchsorted(column, (first, first + SLICE))
        slice_ = np.zeros((m, min(SLICE, int(new.sum()) - first)), dtype=np.float32)
        slice_[row[a:b], column[a:b] - first] = 1
        common += np.rint(slice_ @ slice_.T).astype(np.int64)
        left -= np.bincount(row[a:b], minlength=m)
        possible = possible & (common + np.minimum(left[:, None], left[None, :]) >= need)
    return common, possible


def block_links(keys: list[int], sets: list[np.ndarray], percent: int, fixed: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within a group; where some are fixed, of those between them and the others."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    low, high = np.minimum.outer(n, n), np.maximum.outer(n, n)
    possible = (100 * low >= percent * high) & ~np.eye(len(n), dtype=bool)
    if fixed.any():
        possible &= fixed[:, None] != fixed[None, :]
    if not possible.any():
        return []
    common, possible = overlaps(sets, possible, percent)
    return _forest(keys, possible & (100 * common >= percent * (n[:, None] + n[None, :] - common)), fixed)


def _product(percent: int):
    def run(frames):
        for frame in _groups(frames, ["comp", "pair"], 2_000):
            out = []
            for _, group in frame.groupby(["comp", "pair"], sort=False):
                if len(group) > 1:
                    out += block_links(group[KEY].tolist(), [np.frombuffer(g, dtype=np.uint64) for g in group["grams"]], percent, group["fixed"].to_numpy(bool))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set: its distinct runs of `gram` words (A-Z lower-cased); with fewer words, all of
    them as one; null texts and texts without words have an empty set and no links. Two documents
    link when 100 * intersection >= percent * union; component_id is the smallest id reachable by links.
    Repeated rows and rows with a null id are documents of their own (a component of such rows only has
    a null component_id). An empty table gives an empty result; other columns are ignored.
    """
    keyed = Keyed(docs, id_col, [F.col(text_col).alias("__text")], ["__text"])
    return keyed.restore(classes(keyed.df, gram, percent, block), {KEY: "doc_id", "component": "component_id"}).select("doc_id", "n_shingles", "component_id")


def classes(keyed: DataFrame, gram: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(KEY, n_shingles, component) of a frame with KEY and __text."""
    n = partitions(keyed)
    parts = keyed.select(KEY, "__text").mapInPandas(tidied(_emit(gram, percent)), PARTS)
    met = stored(parts.repartition(n, "h").sortWithinPartitions("h").mapInPandas(tidied(_meet), PARTS), "parts")
    copies = met.where("kind = 3").select(F.col(KEY).alias("a"), F.col("peer").alias("b"))
    near = components(met.where("kind = 1").select(F.col(KEY).alias("a"), F.col("peer").alias("b")))
    leads = met.where("kind = 2 and n > 0").select(KEY, "n", "sketch", F.explode(F.array(F.lit(0), F.lit(1))).alias("step")).withColumn("node", F.expr(f"shiftleft({KEY}, 1) + step"))
    members = stored(near.join(leads, "node").select(KEY, "n", "sketch", "step", F.col("component").alias("comp")), "members")
    counts = members.groupBy("comp").agg(F.count("*").alias("count"), F.min("step").alias("least"), F.min(F.when(F.col("step") == 0, F.struct(KEY, "n"))).alias("lead"))
    # A pair belongs to the level of its larger set, which has step 0 there.
    counts = stored(counts.where("count > 1 and least = 0").select("comp", "count", F.col(f"lead.{KEY}").alias("lead"), "lead.n"), "counts")
    texts, fixed_set = keyed.select(KEY, "__text"), "comp long, pair long, __key long, fixed boolean, grams binary"
    hot = counts.where(F.col("count") > HOT * block).select("comp", "lead", F.col("n").alias("lead_n"), F.ceil(F.col("count") / block).alias("salts"), "count")
    star = None
    if not hot.isEmpty():
        asked = join_heavy(members.select(KEY, "n", "comp"), hot, "comp", "count").where(100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n"))
        asked = stored(asked.select(KEY, "comp", (F.col(KEY) == F.col("lead")).alias("fixed"), "salts"), "asked")
        cut = possible_members(texts, asked).join(asked, KEY).mapInPandas(tidied(_sets(gram, _salts)), fixed_set)
        star = stored(cut.repartition(n, "comp", "pair").sortWithinPartitions("comp", "pair").mapInPandas(tidied(_star(percent)), "comp long, a long, b long"), "star")
        classed = star.select("comp", F.col("a").alias(KEY)).union(hot.select("comp", F.col("lead").alias(KEY))).withColumn("fixed", F.lit(True))
        members = members.join(classed, ["comp", KEY], "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    else:
        members = members.withColumn("fixed", F.lit(False))

    def blocks(rows: DataFrame, most: int) -> DataFrame:
        """(comp, open, fixed_blocks) of components in which pairs are to be looked at."""
        found = rows.groupBy("comp").agg(F.count_if(~F.col("fixed")).alias("u"), F.count_if("fixed").alias("f"))
        found = found.where("u > 0 and u + f > 1").select("comp", F.ceil(F.col("u") / most).alias("open"), F.ceil(F.col("f") / most).alias("fixed_blocks"), F.expr("u + f").alias("count"))
        return stored(found, "blocks")

    open_ = blocks(members, block * SKETCH_BLOCK // BLOCK).join(counts.select("comp"), "comp", "left_semi")
    dealt = join_heavy(members.drop("step"), open_, "comp", "count")
    dealt = dealt.mapInPandas(tidied(_deal), "comp long, pair long, __key long, n int, fixed boolean, sketch binary")
    alike = dealt.repartition(n, "comp", "pair").sortWithinPartitions("comp", "pair").mapInPandas(tidied(_prune(percent)), "a long, b long")
    alike = components(alike.union(star.select("a", "b")) if star is not None else alike).select(F.col("node").alias(KEY), F.col("component").alias("comp"))
    if star is not None:
        # A document can be linked to representatives of two levels; one class of each component is left out of the product.
        alike = stored(alike, "alike")
        within = star.select(F.col("a").alias(KEY), "b").distinct().join(alike, KEY)
        leads = stored(within.groupBy("comp").agg(F.min("b").alias("b"), F.count("*").alias("count")), "leads")
        classed = join_heavy(within.withColumnRenamed("b", "rep"), leads, "comp", "count").where("rep = b").select("comp", KEY).union(leads.select("comp", F.col("b").alias(KEY))).withColumn("fixed", F.lit(True))
        alike = alike.join(classed, ["comp", KEY], "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    else:
        alike = alike.withColumn("fixed", F.lit(False))
    alike = stored(alike, "alike")
    members = stored(join_heavy(alike, blocks(alike, block), "comp", "count"), "members")
    # The others' texts need not shuffle.
    cut = possible_members(texts, members).join(members, KEY).mapInPandas(tidied(_sets(gram, _pairs)), fixed_set)
    links = cut.repartition(n, "comp", "pair").sortWithinPartitions("comp", "pair").mapInPandas(tidied(_product(percent)), "a long, b long").union(copies)
    found = components(links.union(star.select("a", "b")) if star is not None else links)
    sizes = met.where("kind >= 2").select(KEY, F.col("n").cast("long").alias("n_shingles"))
    return sizes.join(found, sizes[KEY] == found["node"], "left").select(KEY, "n_shingles", F.coalesce("component", KEY).alias("component"))
