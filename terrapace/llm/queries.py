"""The registered queries of the corpus operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import damaged, repair
from .embedding_dedup import near_duplicates
from .exact_dedup import exact_dedup
from .mixing import mix_sources
from .ngram_join import ngram_join
from .packing import pack
from .quality import quality_scores
from .secrets import find_secrets
from .suffix_dedup import drop_repeated_bytes
from .url_filter import url_filter
from .warc import round_trip
from .whitening import whiten
from .window_dedup import drop_repeated_windows

#: host, path and verdict of the production rules.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents")).selectExpr("doc_id", "start", "length", "crc32(ids) as ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"), gram=4, percent=85)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(_table(spark, sf_dir, "documents")).drop("kept")


def op6_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_windows(_table(spark, sf_dir, "documents")).drop("kept_text")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "rule_host string, rule_path string, verdict string")
    return url_filter(_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents")).drop("found")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(_table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_ngram_join": op4_ngram_join,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_window_dedup": op6_window_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_mixing": op10_mixing,
    "op11_secrets": op11_secrets,
    "op12_conversations": op12_conversations,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op2_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
  CASE WHEN g.last IS NULL OR g.last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.last <> page_id THEN g.last END AS refers_to
FROM d LEFT JOIN g ON payload_bytes >= 1000 AND d.payload_digest = g.payload_digest
""",
    "op4_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach(doc_id, c) USING KEY (doc_id) AS (
  SELECT doc_id, doc_id AS c FROM d
  UNION
  SELECT l.b, min(r.c) FROM reach r JOIN links l ON l.a = r.doc_id JOIN recurring.reach t ON t.doc_id = l.b WHERE r.c < t.c GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, reach.c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id)
""",
    "op5_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM w) WHERE rn > 1),
g AS (SELECT doc_id, i, CASE WHEN i > 100 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM r),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
x AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM k GROUP BY 1, 2),
y AS (SELECT doc_id, a, b, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM x),
z AS (SELECT d.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, (2 * coalesce(before, 0) + 1)::BIGINT, (2 * (a - coalesce(before, 0)))::BIGINT), '' ORDER BY a) || substr(any_value(h), (2 * max(b) + 1)::BIGINT) AS kept
      FROM y JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id)
""",
    "op6_window_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM s) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d) ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
    "op7_url_filter": r"""
WITH rules(rule_host, rule_path, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
m AS (SELECT page_id, host, path, rule_host || rule_path AS rule, v,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS rn
      FROM h LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE rn = 1
""",
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
""",
    # crc32 bit by bit (256 stands for a shift); then cheapest edits row by row, at most two insertions before each.
    "op12_conversations": r"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
sums AS (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''), lambda ch: [ascii(ch)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
          lambda c, e: CASE WHEN e < 256 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT) % 20 AS what FROM (SELECT DISTINCT k FROM r)),
d AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy FROM r JOIN sums USING (k) WHERE what <> 0),
o AS (SELECT *, coalesce(conv_id::VARCHAR, '') AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM d),
f AS (SELECT *, CASE WHEN core = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, role[1] AS x, lag(role[1]) OVER (PARTITION BY c ORDER BY i) AS before FROM o),
t AS (SELECT c, any_value(i) AS i, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'b')::BIGINT AS blank, count_if(fault = 'd')::BIGINT AS duplicate, count_if(fault = 't')::BIGINT AS truncated, count_if(before || x NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM f GROUP BY c),
ins(q, more, labels, lines, q2) AS (VALUES (0, 0, '', '', 0), (1, 0, '', '', 1), (2, 0, '', '', 2), (3, 0, '', '', 3), (0, 3, 'I', chr(10) || 'user:', 2), (1, 3, 'I', chr(10) || 'user:', 2), (3, 3, 'I', chr(10) || 'user:', 2), (2, 3, 'I', chr(10) || 'assistant:', 3),
     (0, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3), (1, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3)),
arcs(q, x, label, role, q2) AS (VALUES (0, 's', 'K', NULL, 1), (0, 'u', 'K', NULL, 2), (1, 'u', 'K', NULL, 2), (2, 'a', 'K', NULL, 3), (3, 'u', 'K', NULL, 2), (0, NULL, 'R', 'user', 2), (1, NULL, 'R', 'user', 2), (2, NULL, 'R', 'assistant', 3), (3, NULL, 'R', 'user', 2)),
p(c, i, q, w) AS (SELECT DISTINCT c, 0::BIGINT, 0, {cost: 0::BIGINT, audit: '', out: ''} FROM o
 UNION ALL
 SELECT f.c, f.i, CASE WHEN a.label = 'D' THEN n.q2 ELSE a.q2 END,
   min({cost: p.w.cost + n.more + CASE a.label WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN a.label <> 'D' AND fault = 't' THEN 3 ELSE 0 END, audit: p.w.audit || n.labels || a.label, out: p.w.out || n.lines || CASE WHEN a.label = 'D' THEN '' ELSE chr(10) || coalesce(a.role, f.role) || ':' || f.text END})
 FROM p JOIN ins n ON n.q = p.q JOIN f ON f.c = p.c AND f.i = p.i + 1 JOIN (SELECT * FROM arcs UNION ALL SELECT q, NULL, 'D', NULL, q FROM (VALUES (0), (1), (2), (3)) g(q)) a ON a.q = n.q2 AND (a.label = 'D' OR fault NOT IN ('b', 'd') AND (a.x IS NULL OR a.x = f.x)) GROUP BY 1, 2, 3),
best AS (SELECT c, min({cost: p.w.cost + n.more, audit: p.w.audit || n.labels, out: p.w.out || n.lines}) AS w FROM p JOIN t USING (c) JOIN ins n ON n.q = p.q WHERE p.i = t.n AND n.q2 IN (0, 3) GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.w.cost, 0) AS cost, coalesce(best.w.audit, '') AS audit, sha256(coalesce(substr(best.w.out, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN t ON t.c = coalesce(k.conv_id::VARCHAR, '') LEFT JOIN best ON best.c = t.c
""",
}
