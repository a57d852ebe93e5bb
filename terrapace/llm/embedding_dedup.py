"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, reranking.

A rotation learned on a bounded sample turns vectors into balanced binary codes. Every table keys
on one substring of the code; codes of one label that share a substring meet, and those within a radius in Hamming distance
survive. Only survivors' original vectors travel, and decide by cosine in double precision. A pair counts in the first table in which it meets.
Equal vectors are one class beforehand. Large buckets are cut into blocks and each pair of blocks is
one group, so that every pair of a bucket is seen, whatever its size, in groups of bounded size.
How often pairs at the threshold share no substring, and how far apart their codes are, is measured on the sample's own codes; tables are
added until few share none, the radius leaves out fewer still; where the most tables are too few, substrings get shorter, down to none: every pair of a label.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, Keyed, components, mix, partitions, stored
from .spans import _groups

#: Vectors that the rotations are fitted on, at most about (chosen by hash of the id); rounds of fitting.
SAMPLE = 20_000
ROUNDS = 30
#: Vectors of a block; vectors of a label that fill a bucket this much on average get longer substrings.
BLOCK = 96
BUCKET = 256
#: Tables are added until fewer than MISS of the pairs at the threshold share no substring, by at most about PAIRS pairs of each kind; no more than MOST_TABLES.
MISS = 0.03
PAIRS = 4_000
MOST_TABLES = 256
#: Share of the pairs at the threshold whose codes are farther apart than the radius.
BEYOND = 0.002


def substring_bits(largest: int) -> int:
    """Bits of a substring, for labels of at most `largest` vectors."""
    return max(8, math.ceil(math.log2(max(1, largest / BUCKET))))


def _rotations(x: np.ndarray, seed: int):
    """Projections of x (d columns) to d bits each: iterative quantisation, from a random start of its own each."""
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    values, vectors = np.linalg.eigh(x.T @ x / max(1, len(x)))
    vectors = vectors[:, np.argsort(-values)]
    v = x @ vectors
    while True:
        rotation, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(ROUNDS):
            codes = np.where(v @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ v)
            rotation = (left @ right).T
        yield vectors @ rotation


def threshold_pairs(sample: np.ndarray, labels: np.ndarray, least: float, seed: int = 12) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors whose cosine is `least` or little more, of three kinds: two of the sample; one of it and
    its turn towards another of its label; one of it and its turn in any direction."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    x, of = sample[order], labels[order]
    first, second = [], []
    for at in range(0, min(len(x), PAIRS), 250):
        cosine = x[at : at + 250] @ x.T
        near = (cosine >= least) & (cosine <= least + (1 - least) / 4) & (of[at : at + 250, None] == of[None, :])
        a, b = np.nonzero(near)
        some = rng.permutation(len(a))[: PAIRS // 8]
        first.append(a[some] + at)
        second.append(b[some])
    kinds = [(x[np.concatenate(first)], x[np.concatenate(second)])]
    by_label = np.argsort(of, kind="stable")
    towards = np.empty_like(x)
    towards[by_label] = x[np.roll(by_label, 1)]
    alike = np.empty(len(x), dtype=bool)
    alike[by_label] = of[by_label] == of[np.roll(by_label, 1)]
    for other in (np.where(alike[:, None], towards, 0.0)[:PAIRS], rng.standard_normal(x[:PAIRS].shape)):
        one = x[:PAIRS]
        turn = other - (other * one).sum(axis=1, keepdims=True) * one
        length = np.linalg.norm(turn, axis=1)
        one, turn = one[length > 1e-12], turn[length > 1e-12] / length[length > 1e-12, None]
        kinds.append((one, least * one + math.sqrt(max(0.0, 1 - least * least)) * turn))
    return [k for k in kinds if len(k[0])]


def fit_codes(sample: np.ndarray, labels: np.ndarray, bits: int, least: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """(mean, projection to tables * bits columns, bits, tables, radius): as many tables as the pairs at the threshold need."""
    mean = sample.mean(axis=0)
    pairs = threshold_pairs(sample, labels, least)
    if not pairs:
        return mean, np.zeros((sample.shape[1], 0)), 0, 1, 0
    rotations, projection = _rotations(sample - mean, seed), np.zeros((sample.shape[1], 0))
    unlike = [np.zeros((len(a), 0), dtype=bool) for a, _ in pairs]
    for width in range(bits, 0, -1):
        apart = [np.ones(len(a), dtype=bool) for a, _ in pairs]
        for table in range(MOST_TABLES):
            while projection.shape[1] < (table + 1) * width:
                more = next(rotations)
                projection = np.concatenate([projection, more], axis=1)
                unlike = [np.concatenate([u, ((a - mean) @ more >= 0) != ((b - mean) @ more >= 0)], axis=1) for u, (a, b) in zip(unlike, pairs)]
            apart = [miss & u[:, table * width : (table + 1) * width].any(axis=1) for miss, u in zip(apart, unlike)]
            if max(miss.mean() for miss in apart) < MISS:
                apart = [u[:, : (table + 1) * width].sum(axis=1) for u in unlike]
                radius = max(int(np.quantile(x, 1 - BEYOND, method="higher")) for x in apart)
                return mean, projection[:, : (table + 1) * width], width, table + 1, radius
    return mean, projection[:, :0], 0, 1, 0


def _unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares of tiny or huge components lose it
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coder(models: dict):
    def run(frames):
        for frame in frames:
            dims = frame["vec"].map(len)
            for dim, part in frame.groupby(dims):
                mean, projection, bits, tables, _ = models[dim]
                codes = (_unit(part["vec"].tolist()) - mean) @ projection >= 0
                subs = codes.reshape(len(part), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                room = np.zeros((len(part), max(1, -(-tables * bits // 64)) * 64), dtype=bool)
                room[:, : tables * bits] = codes
                yield part.assign(subs=list(subs), code=[c.tobytes() for c in np.packbits(room, axis=1)])[[KEY, "label", "vec", "size", "code", "subs"]]

    return run


GROUP = "label string, dim int, table int, sub long, pair long"
MEMBER = f"{GROUP}, block long, own boolean, __key long, size long, code binary"
KEYS = [x.split()[0] for x in GROUP.split(", ")]


def _blocks(frames):
    """A row for each pair of blocks that a code's block is in."""
    for frame in frames:
        blocks = frame["blocks"].to_numpy(np.int64)
        if not len(frame):
            continue
        mine = (mix(frame[KEY].to_numpy(np.int64).view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
        ends = np.cumsum(blocks)
        for at in range(0, int(ends[-1]), 4096):
            place = np.arange(at, min(at + 4096, int(ends[-1])))
            r = np.searchsorted(ends, place, side="right")
            other = place - (ends - blocks)[r]
            pair = np.minimum(mine[r], other) * blocks[r] + np.maximum(mine[r], other)
            yield frame.iloc[r].assign(pair=pair, block=mine[r], own=mine[r] == other)[[x.split()[0] for x in MEMBER.split(", ")]]


def _candidates(group: pd.DataFrame, table: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group within the radius in Hamming distance that share no substring of an earlier table."""
    code = np.stack([np.frombuffer(c, dtype=np.uint64) for c in group["code"]])
    near = np.triu(np.bitwise_count(code[:, None, :] ^ code[None, :, :]).sum(axis=2, dtype=np.int64) <= radius, 1)
    if not group["own"].iloc[0]:
        block = group["block"].to_numpy()
        near &= block[:, None] != block[None, :]
    a, b = np.nonzero(near)
    if table and bits and len(a):
        unlike = np.unpackbits((code[a] ^ code[b]).view(np.uint8), axis=1)[:, : table * bits].reshape(len(a), table, bits)
        first = unlike.any(axis=2).all(axis=1)
        a, b = a[first], b[first]
    return a, b


def _survivors(models: dict):
    """The rows that have a candidate partner in their group."""

    def run(frames):
        for frame in _groups(frames, KEYS):
            keep = np.zeros(len(frame), dtype=bool)
            for (_, dim, table, _, _), at in frame.groupby(KEYS, sort=False).indices.items():
                if len(at) > 1:
                    a, b = _candidates(frame.iloc[at], table, models[dim][2], models[dim][4])
                    keep[at[a]] = keep[at[b]] = True
            yield frame[keep]

    return run


def _links(models: dict, least: float):
    """n for each vector that has links (b null), and a spanning forest of the links (n = 0)."""

    def run(frames):
        for frame in _groups(frames, KEYS):
            out = []
            for (_, dim, table, _, _), g in frame.groupby(KEYS, sort=False):
                if len(g) < 2:
                    continue
                key, size = g[KEY].to_numpy(), g["size"].to_numpy()
                a, b = _candidates(g, table, models[dim][2], models[dim][4])
                x = _unit(g["vec"].tolist())
                linked = (x @ x.T)[a, b] >= least
                a, b = a[linked], b[linked]
                n = np.bincount(a, weights=size[b], minlength=len(key)) + np.bincount(b, weights=size[a], minlength=len(key))
                out += [(k, None, int(m)) for k, m in zip(key.tolist(), n.tolist()) if m]
                root = list(range(len(key)))

                def find(i, root=root):
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                for i, j in zip(a.tolist(), b.tolist()):
                    ri, rj = find(i), find(j)
                    if ri != rj:
                        root[max(ri, rj)] = min(ri, rj)
                        out.append((int(key[i]), int(key[j]), 0))
            yield pd.DataFrame(out, columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label link when their cosine is at least `least`; those of unlike
    length don't. Null, empty and zero vectors and ones with null or non-finite components link with nothing.
    Repeated rows and rows with a null id are vectors of their own; kept is true for the first of a
    component. An empty table gives an empty result; other columns are ignored. Pairs near the threshold are found
    with probability of about 1 - MISS at least, on the average of the sample's vectors, closer ones more surely;
    no pair below it is linked.
    """
    keyed = Keyed(vectors, id_col, [F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label")], ["label", "vec"])
    result = links(keyed.df, least)
    return keyed.restore(result, {KEY: "vec_id", "component": "component_id"}).select("vec_id", "n_links", "component_id", "kept")


def links(keyed: DataFrame, least: float) -> DataFrame:
    """(KEY, n_links, component, kept) of a frame with KEY, vec and label."""
    n = partitions(keyed)
    sound = F.expr("label is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)")
    usable = keyed.where(F.coalesce(sound, F.lit(False)))
    usable = usable.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # no negative zeros
    same = stored(usable.groupBy("label", "vec").agg(F.min(KEY).alias(KEY), F.count("*").alias("size")), "vectors")
    counts = same.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    largest, total = counts[0] or 0, counts[1] or 0
    if not total:
        return keyed.select(KEY, F.lit(0).cast("long").alias("n_links"), F.col(KEY).alias("component"), F.lit(True).alias("kept"))
    bits = substring_bits(largest)
    dims = [r[0] for r in same.select(F.size("vec")).distinct().collect()]
    models = {}
    for dim in dims:
        some = same.where(F.size("vec") == dim)
        share = SAMPLE / max(1, some.count())
        if share < 1:
            some = some.where(F.pmod(F.xxhash64(KEY, F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))
        rows = some.select("vec", F.xxhash64("label")).collect()
        models[dim] = fit_codes(_unit([r[0] for r in rows]), np.array([r[1] for r in rows]), bits, least) if rows else (np.zeros(dim), np.zeros((dim, 0)), 0, 1, 0)
    coded = stored(same.mapInPandas(_coder(models), "__key long, label string, vec array<double>, size long, code binary, subs array<long>"), "codes")
    in_tables = coded.select(KEY, "label", F.size("vec").alias("dim"), "size", "code", F.posexplode("subs").alias("table", "sub"))
    where = KEYS[:4]
    filled = stored(in_tables.groupBy(*where).count().where("count > 1").select(*where, F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks")), "buckets")
    meet = in_tables.join(filled, where).mapInPandas(_blocks, MEMBER)
    alike = meet.repartition(n, *KEYS).sortWithinPartitions(*KEYS).mapInPandas(_survivors(models), MEMBER)
    rerank = alike.join(coded.select(KEY, "vec"), KEY)
    found = stored(rerank.repartition(n, *KEYS).sortWithinPartitions(*KEYS).mapInPandas(_links(models, least), "a long, b long, n long"), "links")
    near = found.where("b is null").groupBy("a").agg(F.sum("n").alias("near"))
    comps = components(found.where("b is not null").select("a", "b"))
    classes = same.join(near, same[KEY] == near["a"], "left").join(comps, same[KEY] == comps["node"], "left")
    classes = stored(classes.select(F.col("label").alias("l"), F.col("vec").alias("v"), (F.coalesce("near", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", KEY).alias("component")), "classes")
    members = usable.select(KEY, "label", "vec").join(classes, [F.col("label") == F.col("l"), F.col("vec") == F.col("v")]).select(F.col(KEY).alias("k"), "n_links", "component")
    out = keyed.select(KEY).join(members, F.col(KEY) == F.col("k"), "left")
    component = F.coalesce("component", KEY)
    return out.select(KEY, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), (component == F.col(KEY)).alias("kept"))
