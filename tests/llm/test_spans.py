"""Repeated windows of words and of bytes against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from terrapace.llm import spans, suffix_dedup
from terrapace.llm.suffix_dedup import drop_repeated_bytes
from terrapace.llm.window_dedup import drop_repeated_windows

SCHEMA = "doc_id long, text string, n long, start string, n_removed int"


def corpus(seed, docs=60):
    """Documents that share passages, lines and copies; some periodic, empty, null, with repeated ids."""
    r = random.Random(seed)
    words = ["a", "bb", "ccc", "the", "of", "é x", "日本", "Zz", "q" * 30]
    passage = [r.choice(words) + str(r.randrange(50)) for _ in range(120)]
    out = []
    for i in range(docs):
        w = [r.choice(words) + str(r.randrange(2000)) for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 3)):
            a = r.randrange(0, 80)
            w += passage[a : a + r.randrange(5, 60)] + [r.choice(words)]
        out.append((i * 3 % 101, r.choice([" ", "  ", "\n", " \t"]).join(w)))
    out += [(200, None), (201, ""), (202, " \n "), (203, "same " * 90), (204, "same " * 50), (211, "Und " * 40 + "der " * 40 + "once or twice"), (212, "p q r s t u v " * 12 + "z"), (205, "x" * 500), (206, "y" + "x" * 300), (207, "ab" * 180 + "c"), (7, out[5][1]), (None, out[8][1]), (None, None), (208, out[3][1]), (209, out[3][1]), (210, "tail " + passage[0] + " " + " ".join(passage))]
    r.shuffle(out)
    return [(i, t, 1, "x", 2) for i, t in out]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def brute_words(rows, size):
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    seen = Counter(tuple(w[i : i + size]) for _, w in texts for i in range(len(w) - size + 1))
    out = []
    for doc, w in texts:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size,sub,bucket", [(35, 8, 1024), (6, 2, 1024), (6, 2, 3)])
def test_words(spark, size, sub, bucket):
    rows = corpus(size + bucket)
    got = drop_repeated_windows(spark.createDataFrame(rows, SCHEMA).repartition(5), size=size, sub=sub, bucket=bucket)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == brute_words(rows, size)


def brute_bytes(rows, size):
    rows = in_order(rows)
    seen, out = set(), []
    for doc, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size,sub,bucket", [(100, 32, 1024), (24, 6, 1024), (24, 6, 3)])
def test_bytes(spark, size, sub, bucket):
    rows = corpus(size + bucket)
    got = drop_repeated_bytes(spark.createDataFrame(rows, SCHEMA).repartition(5), size=size, sub=sub, bucket=bucket)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute_bytes(rows, size)


def test_long_texts_are_read_in_pieces():
    text = ("abc" * 400 + "z").encode()
    whole = [x for part in suffix_dedup._windows([text], 100, 32, 1 << 20) for x in part[1].tolist()]
    parts = [x for part in suffix_dedup._windows([text], 100, 32, 170) for x in part[1].tolist()]
    assert whole == parts


def test_suffix_sort():
    r = random.Random(5)
    data = bytes(r.choice(b"ab") for _ in range(3000)) + b"a" * 300 + b"\0" * 100
    at = sorted(r.sample(range(3200), 700))
    group = sorted(r.choice(range(9)) for _ in at)
    prefix, raw = suffix_dedup.Prefix(suffix_dedup.BYTE[list(data)]), suffix_dedup.np.frombuffer(data, dtype="u1")
    order = suffix_dedup.suffix_sort(prefix, raw, suffix_dedup.np.array(at), suffix_dedup.np.array(group), 40)
    assert order.tolist() == sorted(range(700), key=lambda i: (group[i], data[at[i] : at[i] + 40], i))


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_a_polynomial_modulo_2_64_confuses(spark):
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    words = [f"w{i}" for i in range(40)]
    rows = [(k, " ".join(words[:20] + [x] + words[20:]), 1, "x", 2) for k, x in enumerate((one, two))]
    rows += [(k + 10, x, 1, "x", 2) for k, x in enumerate((thue_morse(1024, "a ", "b "), thue_morse(1024, "b ", "a ")))]
    for got, want in ((drop_repeated_windows(spark.createDataFrame(rows, SCHEMA)), brute_words(rows, 35)), (drop_repeated_windows(spark.createDataFrame(rows, SCHEMA), size=1000, sub=8), brute_words(rows, 1000))):
        assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == want
    got = drop_repeated_bytes(spark.createDataFrame(rows, SCHEMA), size=1000, sub=32)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute_bytes(rows, 1000)


def test_a_wrong_order_is_put_right():
    np, data = suffix_dedup.np, suffix_dedup.np.frombuffer(b"abcabdabcabd", dtype="u1")
    at, group = np.array([0, 3, 6, 9, 0]), np.array([0, 0, 0, 0, 1])
    order, equal = suffix_dedup.verified(data, at, group, np.array([0, 1, 2, 3, 4]), 3)
    assert order.tolist() == [0, 2, 1, 3, 4] and equal.tolist() == [True, False, True, False]


def test_many_unlike_spans_of_a_minimiser_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT", 5)
    groups = spans._groups
    monkeypatch.setattr(spans, "_groups", lambda frames, columns, least=3: groups(frames, columns, 3))
    rows = corpus(9)
    frames = [f for f in spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(doc_id, -1) as __key", "text as __text").toPandas().pipe(lambda x: [x])]
    emitted = suffix_dedup.pd.concat(spans._emit(lambda t: suffix_dedup._windows(t, 24, 6), True)(frames)).sort_values(["h", "s", "__key", "start"])
    emitted["h"] = emitted["h"].where(emitted["kind"] % 4 == 2, emitted["h"] % 3)
    emitted = emitted.sort_values(["h", "s", "__key", "start"])
    met = suffix_dedup.pd.concat(spans._meet(True, 4)(emitted.iloc[i : i + 7] for i in range(0, len(emitted), 7)))
    monkeypatch.setattr(spans, "HOT", 10**9)
    whole = suffix_dedup.pd.concat(spans._meet(True, 4)([emitted]))
    key = lambda f: sorted(zip(f["h"], f["part"], f["parts"] > 1, f["__key"], f["start"], f["n"], f["kind"]))
    assert key(met) == key(whole) and (met["parts"] > 1).any()


def test_no_documents(spark):
    assert drop_repeated_windows(spark.createDataFrame([], SCHEMA)).count() == 0
    assert drop_repeated_bytes(spark.createDataFrame([], SCHEMA)).count() == 0


def around(phrase, docs, seed=3):
    r = random.Random(seed)
    other = lambda: "".join(r.choice("abcdefghij") for _ in range(70))
    return [(i, other() + phrase + other(), 1, "x", 2) for i in range(docs)]


def test_a_common_minimiser_is_cut_by_a_longer_one():
    texts = [t.encode() for _, t, *_ in around("=the same phrase of forty bytes, or so.=", 300)]
    wanted = [[{"h": 1, "part": k // 8, "parts": 38, "start": 0, "n": len(t) - 99, "kind": 3}] for k, t in enumerate(texts)]
    frame = spans.pd.DataFrame({"__key": range(300), "__text": [t.decode() for t in texts], "__wanted": wanted})
    cut = spans.pd.concat(spans._cut(suffix_dedup.partial(suffix_dedup._content, size=100), suffix_dedup.partial(suffix_dedup._windows, size=100, sub=80))([frame]))
    assert cut["n"].sum() == sum(len(t) - 99 for t in texts) and all(len(c) == n + 99 for c, n in zip(cut["content"], cut["n"]))
    assert all(texts[k][a : a + len(c)] == c for k, a, c in zip(cut["__key"], cut["start"], cut["content"]))
    done = spans._resolve(suffix_dedup.partial(suffix_dedup._resolve, size=100), suffix_dedup.partial(suffix_dedup._window_bytes, size=100), True, 64)([cut.sort_values(["h", "part"])])
    assert sum(map(len, done)) == 0  # no window is sent on by itself


@pytest.mark.parametrize("length", [40, 85, 130])
def test_a_phrase_among_many_others_is_resolved_in_pieces(spark, length):
    rows = around(("=so it is said, and read, and written again and again by all who come" * 2)[:length], 150) + around("!" * 99, 20, 4)
    rows += [(500 + i, rows[i * 7][1][i:], 1, "x", 2) for i in range(12)]
    got = drop_repeated_bytes(spark.createDataFrame(rows, SCHEMA).repartition(5), bucket=1)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute_bytes(rows, 100)
