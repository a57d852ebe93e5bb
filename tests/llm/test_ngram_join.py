"""The n-gram join against brute force."""

import random
import re

import numpy as np
import pytest

from terrapace.llm import ngram_join
from terrapace.llm.ngram_join import ngram_join as join

SCHEMA = "doc_id long, text string, component_id string, n int, h int"


def corpus(seed, n=120):
    r = random.Random(seed)
    out = []
    base = [[f"w{r.randrange(60)}" for _ in range(r.choice([3, 5, 9, 30, 80, 300]))] for _ in range(12)]
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 9])):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = [f"w{r.randrange(60)}"] * r.randrange(2) or ["Y"]
            r.choice(base)[-1] = w[-1]
        out.append((i * 7 % 251, r.choice([" ", "\n", "\t "]).join(w).title() if r.random() < 0.3 else " ".join(w)))
    out += [(300, None), (301, ""), (302, " "), (303, "one"), (304, "ONE"), (305, "one two three"), (306, "one two three"), (307, "É one"), (308, "é one"), (out[3][0], out[3][1]), (None, out[4][1]), (None, None), (309, "a b c d " * 400)]
    r.shuffle(out)
    return [(*x, "c", 1, 2) for x in out]


def brute(rows, gram, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + gram]) for i in range(len(w) - gram + 1)} if len(w) >= gram else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        before = list(root)
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    return sorted(((r[0], len(s), rows[k][0]) for r, s, k in zip(rows, sets, root)), key=repr)


@pytest.mark.parametrize("gram,percent,block", [(4, 85, 64), (5, 80, 64), (4, 85, 3), (2, 60, 5)])
def test_components(spark, gram, percent, block):
    rows = corpus(gram * percent + block)
    got = join(spark.createDataFrame(rows, SCHEMA).repartition(5), gram=gram, percent=percent, block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, gram, percent)


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(2)
    for percent in (85, 80, 60):
        for n in (1, 2, 6, 7, 8, 12, 13, 40, 100, 250, 999, 4000):
            for trial in range(40):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                drop = rng.integers(0, max(1, n // 5) + 1)
                add = rng.integers(0, max(1, n // 5) + 1)
                kept = a if trial % 3 == 0 else rng.permutation(a)
                b = np.unique(np.concatenate((kept[drop:], rng.integers(0, 2**64, add, dtype=np.uint64))))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                    hashes, owner, _ = ngram_join.part_hashes(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), percent)
                    assert set(hashes[owner == 0].tolist()) & set(hashes[owner == 1].tolist())


def test_sketches_never_overstate_a_difference():
    rng = np.random.default_rng(4)
    for n in (0, 1, 30, 1000, 3000, 5000, 20_000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[n // 9 :], rng.integers(0, 2**64, n // 7, dtype=np.uint64))))
        sa, sb = ngram_join.sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        words = min(len(sa), len(sb)) // 8
        bits = int(np.bitwise_count(ngram_join.folded(sa, words) ^ ngram_join.folded(sb, words)).sum())
        assert bits <= len(np.setxor1d(a, b)) and (n < 30 or bits > 0)


def test_words_that_a_polynomial_modulo_2_64_confuses(spark):
    one, two = ("".join(("ab"[i], "ba"[i])[k] for i in (bin(x).count("1") % 2 for x in range(1024))) for k in (0, 1))
    rows = [(k + 1, f"u v w {x} x y z", "c", 1, 2) for k, x in enumerate((one, two))]
    got = join(spark.createDataFrame(rows, SCHEMA), gram=4, percent=100)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 100) == [(1, 4, 1), (2, 4, 2)]


def test_overlaps():
    rng = np.random.default_rng(6)
    for m, most in ((2, 50), (9, 40), (40, 300)):
        sets = [np.unique(rng.integers(0, most, rng.integers(1, most), dtype=np.uint64)) for _ in range(m)]
        want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        n = np.array([len(x) for x in sets])
        linked = (100 * want >= 60 * (n[:, None] + n[None, :] - want)) & ~np.eye(m, dtype=bool)
        common, left = ngram_join.overlaps(sets, ~np.eye(m, dtype=bool), 60)
        assert (linked <= left).all() and (common[left] == want[left]).all()


def test_a_large_component_is_dealt_in_proportion():
    pd = ngram_join.pd
    for open_, others in ((3, 0), (2, 50), (1, 700)):
        n = 10 * (open_ + others)
        frame = pd.DataFrame({"__key": np.arange(n) * 7919, "fixed": np.arange(n) >= 10 * open_, "open": open_, "fixed_blocks": others})
        row, pair = ngram_join._pairs(frame)
        met = pd.DataFrame({"row": row, "pair": pair}).groupby("pair")["row"].apply(set)
        fixed = frame["fixed"].to_numpy()
        wanted = {(i, j) for i in range(10 * open_) for j in range(n) if i < j} if n < 1000 else set()
        seen = {(i, j) for rows in met for i in rows if not fixed[i] for j in rows if i < j}
        assert wanted <= seen and len(row) <= open_ * (n + 10 * others + 10 * open_)


def test_no_documents(spark):
    assert join(spark.createDataFrame([], SCHEMA)).count() == 0
