"""Graphs, pages and items derived from the driver's tables, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..session import durable, table


def session_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, raw_w: from each user to the user of the event with the next number, if it is of the same day."""
    events = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), F.col("user_id").alias("src"))
    after = events.select((F.col("event_id") - 1).alias("event_id"), "day", F.col("src").alias("dst"))
    return graph.from_edges(events.join(after, ["event_id", "day"]).select("src", "dst", F.lit(1.0).alias("raw_w")))


SESSION_SQL = """
g AS (
  SELECT a.user_id AS src, b.user_id AS dst, CAST(count(*) AS DOUBLE) AS raw_w
  FROM events a JOIN events b ON b.event_id = a.event_id + 1 AND CAST(b.ts AS DATE) = CAST(a.ts AS DATE)
  WHERE a.user_id <> b.user_id GROUP BY ALL
), e AS (SELECT src, dst, raw_w, raw_w / sum(raw_w) OVER (PARTITION BY src) AS w FROM g)
"""


def session_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return durable(graph.normalize(session_edges(spark, sf_dir)))


def session_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, cost: users, with a cost of 1 + their number of events."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg((F.count("*") + 1).alias("cost"))


NODES_SQL = "n AS (SELECT user_id AS node, count(*) + 1 AS cost FROM events GROUP BY user_id)"


def doc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, raw_w: from each document to those with the next, the double and half of its number, of weight 1, 2 and 0.5."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    i, to = F.col("doc_id"), lambda dst, w: F.struct(dst.cast("long").alias("dst"), F.lit(w).alias("raw_w"))
    links = F.explode(F.array(to(i + 1, 1.0), to(i * 2, 2.0), to(F.expr("doc_id DIV 2"), 0.5))).alias("e")
    out = ids.select(i.alias("src"), links).select("src", "e.dst", "e.raw_w")
    return graph.from_edges(out.join(ids.select(i.alias("dst")), "dst", "left_semi"))


DOC_SQL = """
g AS MATERIALIZED (
  SELECT src, dst, sum(raw_w) AS raw_w FROM (
    SELECT doc_id AS src, doc_id + 1 AS dst, 1.0::DOUBLE AS raw_w FROM documents
    UNION ALL SELECT doc_id, doc_id * 2, 2.0 FROM documents UNION ALL SELECT doc_id, doc_id // 2, 0.5 FROM documents)
  WHERE src <> dst AND dst IN (SELECT doc_id FROM documents) GROUP BY ALL
), e AS MATERIALIZED (SELECT src, dst, raw_w, raw_w / sum(raw_w) OVER (PARTITION BY src) AS w FROM g)
"""


def doc_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return durable(graph.normalize(doc_edges(spark, sf_dir)))


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, path, body, lang: documents as markdown pages `shelf-<k>/Doc-<id>.md` with links to the pages of the next and the
    double number."""
    name = lambda i: F.concat(F.lit("shelf-"), (i % 10).cast("string"), F.lit("/Doc-"), i.cast("string"))
    i = F.col("doc_id")
    links = F.concat(F.lit(" See [["), name(i + 1), F.lit("|next]] and [["), name(i * 2), F.lit("]]."))
    body = F.concat(F.lit("# "), F.coalesce("source", F.lit("")), F.lit(" "), i.cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")), links)
    return table(spark, sf_dir, "documents").select(i.alias("node"), F.concat(name(i), F.lit(".md")).alias("path"), body.alias("body"), "lang")


WIKI_SQL = """
wiki AS (
  SELECT doc_id AS node, 'shelf-' || doc_id % 10 || '/Doc-' || doc_id || '.md' AS path, lang,
         '# ' || coalesce(source, '') || ' ' || doc_id || chr(10) || chr(10) || coalesce(text, '') ||
         ' See [[shelf-' || (doc_id + 1) % 10 || '/Doc-' || doc_id + 1 || '|next]] and [[shelf-' || doc_id * 2 % 10 || '/Doc-' || doc_id * 2 || ']].' AS body
  FROM documents
)
"""

TOKENS_SQL = r"""
tok AS MATERIALIZED (
  SELECT doc_id AS node, lower(t) AS term FROM (
    SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}]+')) AS t FROM documents) WHERE strlen(t) > 1
), tf AS MATERIALIZED (SELECT node, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
p AS MATERIALIZED (
  SELECT node, term, tf, max_tf, tf / max_tf * (ln(n / df) + 1) AS w
  FROM (SELECT *, CAST(max(tf) OVER (PARTITION BY node) AS DOUBLE) AS max_tf FROM tf) JOIN df USING (term), n
), nrm AS MATERIALIZED (SELECT node, CAST(max(max_tf) AS BIGINT) AS max_tf, sqrt(sum(w * w)) AS norm FROM p GROUP BY node)
"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, score, cost: parts, with their price in whole units as score and their size as cost."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.floor("p_retailprice").cast("double").alias("score"), F.col("p_size").cast("long").alias("cost"))


ITEMS_SQL = "items AS (SELECT p_partkey AS item, CAST(floor(p_retailprice) AS DOUBLE) AS score, CAST(p_size AS BIGINT) AS cost FROM part)"
