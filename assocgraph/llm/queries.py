"""The registered queries of the text operators, and their SQL where SQL can express them.

QUERIES: name -> function of (spark, sf_dir). ORACLES: name -> DuckDB SQL over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, bpe, chat, exact_dedup, fingerprints, html_extract, langid, lexical_search, near_dedup, packing, repair, substring_dedup, toxicity
from .common import Tables, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bpe.default_vocabulary()
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.texts(table(spark, sf_dir, "pages"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("size")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build(table(spark, sf_dir, "documents"), Tables(spark, "snappy"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations"))).withColumnRenamed("sha256", "repaired_sha256")


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), best_fit.default_vocabulary(), Tables(spark))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_html_extract": op2_html_extract,
    "op3_near_dedup": op3_near_dedup,
    "op4_chat": op4_chat,
    "op5_langid": op5_langid,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_fingerprints": op8_fingerprints,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_repair": op12_repair,
    "op13_best_fit": op13_best_fit,
}

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents
), g AS (
  SELECT bare, arg_min(doc_id, (-size, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY bare
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256
FROM d JOIN g USING (bare)
"""

OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         CASE WHEN role = 'assistant' THEN 'result' ELSE 'call' END AS kind,
         conv_id || '-' || CASE WHEN role = 'assistant' THEN turn - 1 ELSE turn END AS id
  FROM conversations
), c AS (SELECT conv_id, id, min(turn) AS call_turn FROM t WHERE kind = 'call' GROUP BY ALL),
r AS (SELECT conv_id, id, max(turn) AS result_turn FROM t WHERE kind = 'result' GROUP BY ALL),
j AS (
  SELECT t.*, CASE WHEN kind = 'call' THEN coalesce(result_turn > turn, false) ELSE coalesce(call_turn < turn, false) END AS linked,
         array_to_string(list_filter([CASE WHEN role NOT IN ('system', 'user') THEN 'role not permitted' END, CASE WHEN text = '' THEN 'text empty' END], lambda x: x IS NOT NULL), '; ') AS wrong
  FROM t LEFT JOIN c USING (conv_id, id) LEFT JOIN r USING (conv_id, id)
)
SELECT conv_id, turn, 0 AS position, kind, id, CASE WHEN kind = 'call' THEN 'reply' END AS name, linked,
       kind = 'result' OR wrong = '' AS valid, CASE WHEN kind = 'call' THEN wrong END AS violations,
       CASE WHEN kind = 'result' AND linked THEN 1 ELSE 0 END AS level,
       CASE WHEN kind = 'call'
         THEN '{"arguments":{"role":' || to_json(role) || ',"text":' || to_json(text) || ',"turn":' || turn || '},"id":' || to_json(id) || ',"name":"reply","type":"call"}'
         ELSE '{"content":' || to_json(text) || ',"id":' || to_json(id) || ',"type":"result"}' END AS json
FROM j
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)
), f AS (
  SELECT win, min(doc_id) AS first_id FROM w GROUP BY win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM w JOIN f USING (win) WHERE first_id < doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following
  FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)
), e AS (
  SELECT *, left(text, length(text) - length(text) // 2) || left(following, length(text) // 2) AS edited FROM o
), t AS (SELECT text FROM e UNION SELECT edited FROM e),
leaves AS (
  SELECT text, list_transform(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda s: list_transform(string_split(s, chr(10)), lambda p:
           list_transform(CASE WHEN len(regexp_extract_all(p, '[\x09-\x0D\x20]*(?:[^\x09-\x0D\x20]{1,16}[\x09-\x0D\x20]*){1,8}')) = 0 THEN [p]
                               ELSE regexp_extract_all(p, '[\x09-\x0D\x20]*(?:[^\x09-\x0D\x20]{1,16}[\x09-\x0D\x20]*){1,8}') END, lambda l: sha256(l)))) AS tree
  FROM t
), paragraphs AS (
  SELECT text, list_transform(tree, lambda s: list_transform(s, lambda p: {'d': sha256(array_to_string(p, '')), 't': array_to_string(list_transform(p, lambda l: left(l, 8)), '')})) AS tree,
         list_distinct(list_transform(flatten(flatten(tree)), lambda l: left(l, 8))) AS leaf
  FROM leaves
), sections AS (
  SELECT text, leaf, list_transform(tree, lambda s: {'d': sha256(array_to_string(list_transform(s, lambda p: p.d), '')),
           't': array_to_string(list_transform(s, lambda p: left(p.d, 12) || ':' || p.t), ',')}) AS tree
  FROM paragraphs
), f AS (
  SELECT text, leaf, sha256(array_to_string(list_transform(tree, lambda s: s.d), '') || sha256(text)) || '/' ||
           array_to_string(list_transform(tree, lambda s: left(s.d, 16) || '=' || s.t), '/') AS fp
  FROM sections
)
SELECT e.doc_id, CAST(length(e.text) AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
       CASE WHEN a.fp = b.fp THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.leaf, b.leaf)) / (len(a.leaf) + len(b.leaf)) END AS near_edited,
       CASE WHEN a.fp = c.fp THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.leaf, c.leaf)) / (len(a.leaf) + len(c.leaf)) END AS near_next
FROM e JOIN f a ON a.text = e.text JOIN f b ON b.text = e.edited JOIN f c ON c.text = e.following
"""

OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS d FROM documents)
), tf AS MATERIALIZED (SELECT doc_id, d, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, d, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
g AS (SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM n),
m AS (SELECT d, 25 + (75 * n * n_all) // l_all AS m FROM n, g),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_all + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
s AS (
  SELECT item_id, doc_id, d, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (d) GROUP BY ALL
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

# crc32 by a table of its 256 steps; then a walk over each conversation's turns that carries, for each of the four states, the
# least (cost, audit) and the text so far, and closes each layer by inserts of a user and an assistant turn
OP12_SQL = r"""
WITH RECURSIVE step(k, v, i) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL SELECT k, xor(v >> 1, (v & 1) * 3988292384), i + 1 FROM step WHERE i < 8
), crc AS (SELECT list(v ORDER BY k) AS tbl FROM step WHERE i = 8),
c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
             lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc
), e AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM c)
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY r) || left(role, 1) AS pair FROM o),
f AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM p
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS r, {'c': 0, 'a': '', 't': NULL::VARCHAR} AS n, NULL::STRUCT(c INT, a VARCHAR, t VARCHAR) AS s, {'c': 5, 'a': 'I', 't': 'user:'} AS u, {'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'} AS z
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, r, n, s, u,
         list_min(list_filter([z, {'c': u.c + 5, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}], lambda x: x.c IS NOT NULL)) AS z
  FROM (
    SELECT conv_id, r, n, s, z,
           list_min(list_filter([u, {'c': n.c + 5, 'a': n.a || 'I', 't': concat_ws(chr(10), n.t, 'user:')}, {'c': s.c + 5, 'a': s.a || 'I', 't': concat_ws(chr(10), s.t, 'user:')},
                                 {'c': z.c + 5, 'a': z.a || 'I', 't': concat_ws(chr(10), z.t, 'user:')}], lambda x: x.c IS NOT NULL)) AS u
    FROM (
      SELECT w.conv_id, f.r, {'c': w.n.c + 2, 'a': w.n.a || 'D', 't': w.n.t} AS n,
             list_min(list_filter([{'c': w.s.c + 2, 'a': w.s.a || 'D', 't': w.s.t},
               {'c': CASE WHEN stays AND left(role, 1) = 's' THEN w.n.c + more END, 'a': w.n.a || 'K', 't': concat_ws(chr(10), w.n.t, role || ':' || text)}], lambda x: x.c IS NOT NULL)) AS s,
             list_min(list_filter([{'c': w.u.c + 2, 'a': w.u.a || 'D', 't': w.u.t}]
               || list_transform([w.n, w.s, w.z], lambda q: {'c': CASE WHEN stays AND left(role, 1) = 'u' THEN q.c + more END, 'a': q.a || 'K', 't': concat_ws(chr(10), q.t, role || ':' || text)})
               || list_transform([w.n, w.s, w.z], lambda q: {'c': CASE WHEN stays THEN q.c + 1 + more END, 'a': q.a || 'R', 't': concat_ws(chr(10), q.t, 'user:' || text)}), lambda x: x.c IS NOT NULL)) AS u,
             list_min(list_filter([{'c': w.z.c + 2, 'a': w.z.a || 'D', 't': w.z.t},
               {'c': CASE WHEN stays AND left(role, 1) = 'a' THEN w.u.c + more END, 'a': w.u.a || 'K', 't': concat_ws(chr(10), w.u.t, role || ':' || text)},
               {'c': CASE WHEN stays THEN w.u.c + 1 + more END, 'a': w.u.a || 'R', 't': concat_ws(chr(10), w.u.t, 'assistant:' || text)}], lambda x: x.c IS NOT NULL)) AS z
      FROM walk w JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM f) f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.r = w.r + 1
    )
  )
), best AS (SELECT conv_id, list_min([n, z]) AS b FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY r DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(b.b.c AS BIGINT) AS cost, b.b.a AS audit, sha256(coalesce(b.b.t, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""

ORACLES = {"op4_chat": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op8_fingerprints": OP8_SQL, "op10_substring_dedup": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_repair": OP12_SQL}
