"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, gif_media, kmeans, licences, minhash_dedup, pieces, quality, substring_dedup, token_files, toxicity, url_rules, warc
from .common import table

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.store_and_read(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.store_and_read(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontamination": op1_decontamination, "op2_licence_scan": op2_licence_scan, "op3_sentencepiece": op3_sentencepiece, "op4_warc": op4_warc, "op5_quality": op5_quality, "op6_gif_media": op6_gif_media, "op7_toxicity": op7_toxicity, "op8_minhash_dedup": op8_minhash_dedup, "op9_substring_dedup": op9_substring_dedup, "op10_url_filters": op10_url_filters, "op11_conversation_repair": op11_conversation_repair, "op12_token_files": op12_token_files, "op13_centroid_clustering": op13_centroid_clustering}


OP4_SQL = """
WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM r
"""

OP10_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
k(rule, verdict, h, p) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
                                  ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
m AS (SELECT s.page_id, k.rule, k.verdict, row_number() OVER (PARTITION BY s.page_id ORDER BY length(k.h) DESC, length(k.p) DESC) AS n
      FROM s JOIN k ON (s.host = k.h OR s.host LIKE '%.' || k.h) AND starts_with(s.path, k.p))
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM s LEFT JOIN m ON m.page_id = s.page_id AND m.n = 1
"""


OP8_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i::BIGINT, (i + 4)::BIGINT), ' ') AS g FROM t, UNNEST(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END)::BIGINT)) u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT e.u, e.v FROM e JOIN n x ON x.doc_id = e.u JOIN n y ON y.doc_id = e.v WHERE 100 * e.c >= 85 * (x.n + y.n - e.c)),
r AS (WITH RECURSIVE r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u) SELECT u, min(v) AS m FROM r GROUP BY u)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(r.m, t.doc_id)) AS component_id, t.doc_id = least(t.doc_id, coalesce(r.m, t.doc_id)) AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN r ON r.u = t.doc_id
"""

OP9_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(list_slice(w, i::BIGINT, (i + 12)::BIGINT), ' ') AS g FROM t, UNNEST(range(1, greatest(len(w) - 11, 1)::BIGINT)) u(i)),
m AS (SELECT g, min(doc_id) AS first_doc FROM p GROUP BY g),
d AS (SELECT DISTINCT p.doc_id, p.i + o.k AS i FROM p JOIN m ON m.g = p.g AND m.first_doc < p.doc_id, UNNEST(range(0, 13)) o(k)),
x AS (SELECT t.doc_id, u.i, t.w[u.i::BIGINT] AS word FROM t, UNNEST(range(1, (len(t.w) + 1)::BIGINT)) u(i)),
k AS (SELECT x.doc_id, count(*) AS kept, string_agg(x.word, ' ' ORDER BY x.i) AS txt FROM x LEFT JOIN d ON d.doc_id = x.doc_id AND d.i = x.i WHERE d.i IS NULL GROUP BY x.doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, (len(t.w) - coalesce(k.kept, 0))::BIGINT AS n_removed, sha256(coalesce(k.txt, '')) AS kept_sha256
FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""


# Forward costs with the audit beside them: of paths to one state at one cost the least audit may stand for all, as no audit of a cheapest path begins another.
OP11_SQL = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
-- crc32, a table of 256 entries by eight shifts, folded over the bytes of the key
tab AS (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c // 2) ELSE c // 2 END) AS c FROM range(0, 256) r(b))),
lot AS (SELECT k, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i::BIGINT])::UBIGINT)), lambda c, x: xor(tab.tab[(xor(c % 256, x) + 1)::BIGINT], c // 256))) % 20 AS lot
        FROM (SELECT DISTINCT k FROM o), tab),
d AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, CASE WHEN lot = 3 THEN 2 ELSE 1 END AS copies
      FROM o JOIN lot USING (k) WHERE lot <> 0),
e AS (SELECT d.conv_id, turn, role, text, row_number() OVER (PARTITION BY d.conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d, UNNEST(range(0, copies)) u(j)),
f AS (SELECT *, rtrim(text, E' 	

') AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS later, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS prior, count(*) OVER (PARTITION BY conv_id) AS size FROM e),
g AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN later THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             prior IS NOT NULL AND left(prior, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS bad FROM f),
st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
              count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM g GROUP BY conv_id),
-- a state is (cost, audit, repaired rows); n, s, u, a: what the repaired roles end in
r(conv_id, i, size, n, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, max(size), {'c': 0::BIGINT, 'e': '', 'o': []::VARCHAR[]}, {'c': 1000000000::BIGINT, 'e': '', 'o': []::VARCHAR[]}, {'c': 1000000000::BIGINT, 'e': '', 'o': []::VARCHAR[]}, {'c': 1000000000::BIGINT, 'e': '', 'o': []::VARCHAR[]} FROM g GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, size,
         {'c': n.c + 2, 'e': n.e || 'D', 'o': n.o},
         list_min([{'c': s.c + 2, 'e': s.e || 'D', 'o': s.o}, {'c': n.c + CASE WHEN must OR x <> 's' THEN 1000000000 ELSE due END, 'e': n.e || 'K', 'o': list_append(n.o, role || ':' || text)}]),
         list_min([{'c': u.c + 2, 'e': u.e || 'D', 'o': u.o}] || list_transform([n, s, a], lambda q: {'c': q.c + CASE WHEN must OR x <> 'u' THEN 1000000000 ELSE due END, 'e': q.e || 'K', 'o': list_append(q.o, role || ':' || text)})
                  || list_transform([n, s, a], lambda q: {'c': q.c + CASE WHEN must THEN 1000000000 ELSE due + 1 END, 'e': q.e || 'R', 'o': list_append(q.o, 'user:' || text)})),
         list_min([{'c': a.c + 2, 'e': a.e || 'D', 'o': a.o}, {'c': u.c + CASE WHEN must OR x <> 'a' THEN 1000000000 ELSE due END, 'e': u.e || 'K', 'o': list_append(u.o, role || ':' || text)},
                   {'c': u.c + CASE WHEN must THEN 1000000000 ELSE due + 1 END, 'e': u.e || 'R', 'o': list_append(u.o, 'assistant:' || text)}])
  FROM (SELECT conv_id, i, size, n, s, u, list_min([a, {'c': u.c + 5, 'e': u.e || 'I', 'o': list_append(u.o, 'assistant:')}]) AS a, role, text, x, must, due
        FROM (SELECT r.conv_id, g.i, r.size, r.n, r.s, r.a, list_min([r.u] || list_transform([r.n, r.s, r.a], lambda q: {'c': q.c + 5, 'e': q.e || 'I', 'o': list_append(q.o, 'user:')})) AS u,
                     g.role, g.text, left(g.role, 1) AS x, g.fault IN ('blank', 'duplicate') AS must, CASE WHEN g.fault = 'truncated' THEN 5 ELSE 0 END AS due
              FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i + 1))),
t AS (SELECT conv_id, list_min([n, a, {'c': u.c + 5, 'e': u.e || 'I', 'o': list_append(u.o, 'assistant:')}, {'c': s.c + 10, 'e': s.e || 'II', 'o': list_concat(s.o, ['user:', 'assistant:'])}]) AS b FROM r WHERE i = size)
SELECT c.conv_id, coalesce(st.gaps, 0)::BIGINT AS gaps, coalesce(st.blank, 0)::BIGINT AS blank, coalesce(st.duplicate, 0)::BIGINT AS duplicate, coalesce(st.truncated, 0)::BIGINT AS truncated, coalesce(st.illegal, 0)::BIGINT AS illegal,
       coalesce(t.b.c, 0)::BIGINT AS cost, coalesce(t.b.e, '') AS audit, sha256(coalesce(array_to_string(t.b.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _clustering_sql(rounds: int = 5) -> str:
    distance = "list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "h AS (SELECT v, sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h, v LIMIT 40)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM h)",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT v.r, v.vec_id, v.v, min({{'d': {distance}, 'k': c.k}}) AS b FROM v CROSS JOIN c{i} c GROUP BY v.r, v.vec_id, v.v)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT b.k AS k, u.i, sum(v[u.i::BIGINT])::BIGINT AS s, count(*) AS n FROM a{i}, UNNEST(range(1, 65)) u(i) GROUP BY b.k, u.i)")
            steps.append(f"m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{i} GROUP BY k)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)")
    last = f"""SELECT a.vec_id, a.b.k::INTEGER AS cluster, a.b.d AS distance, (sum(a.b.d) OVER (PARTITION BY a.b.k))::BIGINT AS cluster_inertia,
       (sum(a.b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.k = a.b.k"""
    return "WITH " + ",\n".join(steps) + "\n" + last


OP13_SQL = _clustering_sql()


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op8_minhash_dedup": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op10_url_filters": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op13_centroid_clustering": OP13_SQL}
