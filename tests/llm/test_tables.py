"""Packing, WARC, url rules, exact dedup and mixing against brute force, with awkward rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from terrapace.llm import common, mixing, packing, warc
from terrapace.llm import exact_dedup as exact_module
from terrapace.llm.exact_dedup import exact_dedup
from terrapace.llm.mixing import mix_sources
from terrapace.llm.packing import pack
from terrapace.llm.url_filter import url_filter

DOCS = [
    (1, "the cat sat on the mat", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "the cat  sat on\tthe mat ", "en", "b"),
    (5, "word " * 9000, "en", "b"),
    (5, "word " * 9000, "en", "b"),
    (None, "It's naïve: 12 cafés!", "fr", "c"),
    (None, None, None, None),
    (9, "a\u00a0b \u0301x <|endoftext|> C", "fr", "\U0001f600"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows=DOCS):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as size", "2 as kept", "'x' as __spare", "3 as sequence_id", "4 as n")


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]+", "", t or "")


def test_exact_dedup(spark):
    rows = exact_dedup(frame(spark)).collect()
    assert len(rows) == len(DOCS)
    groups = Counter(squeeze(r[1]) for r in DOCS)
    assert sorted(r.group_size for r in rows) == sorted(groups[squeeze(r[1])] for r in DOCS)
    assert sum(r.kept for r in rows) == len(groups)
    at = {r.doc_id: r for r in rows if r.doc_id not in (None, 5)}
    assert (at[1].keep_id, at[1].kept, at[4].kept) == (4, False, True)
    assert [r.kept for r in rows if r.doc_id == 5].count(True) == 1
    assert exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_in_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 2400}") for i in range(3000)], "doc_id long, text string")
    whole = sorted(map(tuple, exact_dedup(docs).collect()))
    monkeypatch.setattr(exact_module, "MOST_CELLS", 1 << 13)
    sliced = exact_dedup(docs)
    assert sorted(map(tuple, sliced.collect())) == whole and sum(r[2] == 2 for r in whole) == 1200
    again = []
    monkeypatch.setattr(exact_module, "stored", lambda df, name: again.append(df.count()) or df if name == "groups" else common.stored(df, name))
    exact_dedup(docs).collect()
    assert 600 <= again[0] <= 1000  # most rows that are alone still pass straight through
    keyed = docs.withColumnRenamed("doc_id", "__key")
    assert exact_module.without(keyed, keyed.where("__key % 3 = 0").select("__key")).count() == 2000
    assert exact_module.possible_members(keyed, keyed.where("__key % 3 = 0")).count() >= 1000


def test_packing(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc_id, text, *_ in DOCS:
        want[doc_id, tuple([*tok.encode(text or "", add_special_tokens=False).ids, 2])] += 1
    rows = pack(frame(spark), longest=64, pool_tokens=500).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, tuple(ids)))
    for parts in sequences.values():
        at = 0
        for offset, length, whole in sorted(parts):
            assert offset == at
            at += length
        assert at == whole and whole & (whole - 1) == 0
    for (doc_id, ids), n in want.items():
        got = sorted(pieces[doc_id, len(ids)])
        assert sum(len(x) for _, x in got) == n * len(ids)
        assert all(ids[s : s + len(x)] == x for s, x in got)
    assert pack(frame(spark, [])).count() == 0


def test_pack_pool_keeps_every_token():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300):
        lengths = [int(x) for x in rng.integers(1, 9000, n)]
        seen = defaultdict(int)
        for size, window in packing.pack_pool(lengths):
            assert sum(p[2] for p in window) == size <= 4096 and size & (size - 1) == 0
            for k, _, m in window:
                seen[k] += m
        assert [seen[k] for k in range(n)] == lengths


def test_each_tier_is_packed_into_windows_of_its_own():
    rng = np.random.default_rng(4)
    lengths = [int(x) for x in np.exp(rng.uniform(3, 9, 3000))]
    sizes, whole = Counter(), Counter()
    for size, window in packing.pack_pool(lengths):
        sizes[size] += 1
        whole[size] += any(at == 0 and n == lengths[k] for k, at, n in window)
        longest = max(packing.tier_of(n) for _, _, n in window)
        assert longest <= max(size, 256)
    assert all(sizes[t] > 20 for t in (256, 512, 1024, 2048, 4096))
    assert all(whole[t] > 0.5 * sizes[t] for t in (512, 1024, 2048))


def test_warc_round_trip(spark):
    same = "é" * 600
    pages = [(1, "http://a/", same), (2, None, same), (3, "u\r\nv", same), (4, "x", "short"), (5, "x", "short"), (6, "y", None), (None, "z", same), (7, "q", "")]
    rows = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as payload_bytes")).collect()}
    assert len(rows) == len(pages)
    assert (rows[3].record_type, rows[3].refers_to, rows[1].record_type, rows[1].refers_to) == ("response", None, "revisit", 3)
    assert rows[None].refers_to == 3 and rows[4].record_type == rows[5].record_type == "response"
    assert rows[1].payload_bytes == 1200 and rows[6].payload_bytes == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reads_only_what_is_listed_and_fails_on_what_is_broken(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * 40 * i) for i in range(200)], "page_id long, url string, html string")
    rows = warc.round_trip(pages, folder=str(tmp_path / "a"), most=5000).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in rows) == [(i, 40 * i) for i in range(200)]
    files = sorted((tmp_path / "a").glob("*.zst"))
    assert len(files) > 80
    (tmp_path / "a" / "part-000000-09999-7.warc.zst").write_bytes(files[0].read_bytes())  # of an attempt that was not committed
    written = spark.read.parquet(str(tmp_path / "a-written"))
    assert warc._pages(warc.read_archives(spark, str(tmp_path / "a"), written)).count() == 200
    assert warc.read_archives(spark, str(tmp_path / "a")).count() > 200
    files[3].write_bytes(files[3].read_bytes()[:-3])
    with pytest.raises(Exception, match="an archive can't be read"):
        warc._pages(warc.read_archives(spark, str(tmp_path / "a"), written)).collect()


def test_frames_are_walked_by_their_headers():
    import zstandard

    records = [b"a" * n for n in (0, 1, 500, 300_000)] + [bytes(np.random.default_rng(1).integers(0, 256, 400_000, dtype=np.uint8))]
    for options in ({}, {"write_checksum": True}, {"write_content_size": False}):
        frames = [zstandard.ZstdCompressor(level=3, **options).compress(r) for r in records]
        whole, at = memoryview(b"".join(frames)), 0
        for f in frames:
            at += len(f)
            assert warc.frame_end(whole, at - len(f)) == at


def test_warc_rejects_what_is_broken():
    good = warc.build_record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert warc.parse_record(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"Content-Length: 7", b"Content-Length: 8"), good.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"), good.replace(b"WARC-Date", b"WARC-Dat"), good.replace(b"Payload-Length: 7", b"Payload-Length: 9"), good.replace(b"Payload-Length: 7", b"Payload-Length: x")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    archive = warc.write_archive([good, good.replace(b"WARC-Date", b"WARC-Dat"), good], warc.train([good] * 3))
    assert [r["error"] is None for r in warc.read_archive(archive)] == [True, False, True]
    assert [r["error"] is None for r in warc.read_archive(archive[:-3])] == [True, False, False]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://example.net", "http://Sub.EXAMPLE.net/en/x?q#f", "https://example.com/de/?a", "http://example.com/de", "ftp://a.org/fr/", "http://org/fr/", "http://xnet/", "http://net#x", "a://b://net/", "http://example.com/de/\nx"]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(1, ""), (None, "http://net/")], "page_id long, url string").selectExpr("*", "'r' as rule", "1 as host", "2 as __url", "3 as __verdict", "4 as __page")
    got = url_filter(pages, spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")).collect()
    assert len(got) == len(urls) + 2

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judge(r.url)
    assert url_filter(pages.limit(0), spark.createDataFrame([], "rule_host string, rule_path string, verdict string")).count() == 0


def test_fit_reaches_what_brute_force_reaches():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = np.unique(rng.integers(0, 30, 4))
        counts = rng.integers(1, 4, len(sizes))
        total = int((sizes * counts).sum())
        for budget in {0, 1, total // 2, max(0, total - 1), total, total + 5}:
            took = mixing.fit(sizes, counts, budget)
            assert (took >= 0).all() and (took <= counts).all()
            assert int((sizes * took).sum()) <= budget
        assert int((sizes * mixing.fit(sizes, counts, total // 2)).sum()) == best(sizes, counts, total // 2)


def best(sizes, counts, budget):
    grid = np.array(np.meshgrid(*[range(c + 1) for c in counts])).reshape(len(sizes), -1)
    sums = (sizes[:, None] * grid).sum(0)
    return int(sums[sums <= budget].max())


def test_fit_reaches_budgets_of_long_documents():
    four = np.array([100_000, 110_000, 120_000, 130_000])
    assert mixing.fit(four, np.ones(4, dtype=int), 130_000).tolist() == [0, 0, 0, 1]
    assert int((four * mixing.fit(four, np.ones(4, dtype=int), 229_000)).sum()) == 220_000
    rng = np.random.default_rng(8)
    for _ in range(15):
        sizes = np.unique(rng.integers(60_000, 140_000, 5))
        counts = rng.integers(1, 3, len(sizes))
        for budget in rng.integers(65_537, int((sizes * counts).sum()), 4).tolist():
            took = mixing.fit(sizes, counts, budget)
            assert (took <= counts).all() and int((sizes * took).sum()) == best(sizes, counts, budget)
    sizes, counts = np.arange(2, 20_000, 2), np.full(9_999, 3)
    odd = int((sizes * counts).sum()) // 2 // 2 * 2 + 1
    assert int((sizes * mixing.fit(sizes, counts, odd)).sum()) == odd - 1


def test_knapsacks_of_long_documents_are_exact():
    sizes = np.array([5_000_001, 7_000_003, 9_000_005, 40_000_000])
    took = mixing.fit(sizes, np.full(4, 3), 45_000_001)
    assert int((sizes * took).sum()) == 45_000_001
    rng = np.random.default_rng(8)
    for _ in range(25):
        sizes = np.unique(rng.integers(2_000_000, 9_000_000, 5))
        counts = rng.integers(1, 3, len(sizes))
        sums = {0}
        for size, count in zip(sizes.tolist(), counts.tolist()):
            sums = {s + k * size for s in sums for k in range(count + 1)}
        budget = int(rng.integers(5_000_000, 40_000_000))
        took = mixing.knapsack(sizes, counts, budget)
        assert (took <= counts).all() and int((sizes * took).sum()) == max(s for s in sums if s <= budget)


def test_reruns_agree_where_ids_repeat(spark):
    rows = [(i % 300 if i % 7 else None, f"{'word ' * (i % 23 + 1)}{i % 900}", "x", "ab"[i % 2]) for i in range(2400)] + [(5, "same text here", "x", "a")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    result = lambda parts: sorted(map(repr, mix_sources(docs.repartition(parts)).collect()))
    assert result(3) == result(3) == result(7)


def test_mixing(spark):
    docs = [(1000 + i, "w " * (i % 17), "en", f"s{i % 3}" if i % 5 else "s0") for i in range(400)] + DOCS
    rows = mix_sources(frame(spark, docs)).collect()
    again = mix_sources(frame(spark, docs).repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(docs)
    source = {d[0]: d[3] for d in docs if d[0] is not None}
    taken, target, whole = Counter(), {}, Counter()
    for r in rows:
        assert r.taken <= 3 * r.size and (r.taken == 0 if r.size == 0 else r.taken % r.size == 0)
        if r.doc_id is not None:
            taken[source[r.doc_id]] += r.taken
            target[source[r.doc_id]] = r.target
            whole[source[r.doc_id]] = r.source_size
    assert whole["b"] == 18006 and whole["s0"] == sum(len(d[1].split()) for d in docs if d[3] == "s0")
    for s in ("s0", "s1", "s2"):
        assert abs(taken[s] - target[s]) <= 8
    assert all(target[s] <= 3 * whole[s] for s in target)
    assert mix_sources(frame(spark, [])).count() == 0


def test_crc_is_of_little_endian_ids(spark):
    row = pack(spark.createDataFrame([(1, "the cat")], "doc_id long, text string")).selectExpr("ids", "crc32(ids) c").first()
    assert row.c == zlib.crc32(row.ids)


def test_records_of_other_archives():
    """What other writers' archives hold: info records without digests, HTTP messages whose digest is the body's, revisits that name a target only."""

    def record(kind, block, **more):
        fields = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2024-01-01T00:00:00Z"} | {k.replace("_", "-"): v for k, v in more.items()} | {"Content-Length": str(len(block))}
        return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block + b"\r\n\r\n"

    sha1 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    head, body, chunked = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", b"<p>hello</p>", b"5\r\n<p>he\r\n7;x=1\r\nllo</p>\r\n0\r\n\r\n"
    http = {"Content_Type": "application/http; msgtype=response"}
    info = warc.parse_record(record("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"))
    assert (info["record_type"], info["payload_bytes"], info["payload_digest"]) == ("warcinfo", 13, hashlib.sha1(b"software: x\r\n").hexdigest())
    got = warc.parse_record(record("response", head + body, WARC_Payload_Digest=sha1(body), WARC_Block_Digest=sha1(head + body), **http))
    assert got["payload"] == body and got["payload_bytes"] == len(body) and got["payload_digest"] == hashlib.sha1(body).hexdigest()
    assert warc.parse_record(record("response", head + chunked, WARC_Payload_Digest=sha1(body), **http))["payload"] == chunked
    assert warc.parse_record(record("response", head + chunked, WARC_Payload_Digest=sha1(chunked), **http))["payload"] == chunked
    assert warc.parse_record(record("resource", body, WARC_Payload_Digest="sha256:" + hashlib.sha256(body).hexdigest()))["payload_digest"].startswith("sha256:")
    assert warc.parse_record(record("metadata", b"", WARC_Payload_Digest="tiger:abc"))["payload_bytes"] == 0
    again = warc.parse_record(record("revisit", head, WARC_Payload_Digest=sha1(body), WARC_Refers_To_Target_URI="http://a/", **http))
    assert (again["payload"], again["payload_bytes"], again["refers_to"]) == (None, None, None)
    for bad in (record("response", head + body, WARC_Payload_Digest=sha1(head + body), **http), record("response", body, WARC_Block_Digest=sha1(b"x")), record("resource", body, WARC_Payload_Digest="sha1:!!"), record("revisit", b"")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
