"""Queries over stored terms, ranges, many paths, keyed streams, page folders and random
numbers, each with its SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph, metrics, randoms, spread, tfidf
from ..session import new_folder, table
from ..sources import bulk, corpus, store
from ..sources.markdown import MarkdownFolder
from ..sources.terms import TermStore
from ..streaming import keyed
from . import inputs as inp
from .core import HARD, IGNITE_SQL, QUERY, SIGMOID, r6, register, seeds, spread_sql


#: So buckets of a stored index grow in number, not in size.
DOCS_OF_A_BUCKET = 10_000


@register(f"WITH {IGNITE_SQL} SELECT node, round(a, 6) AS a FROM a0")
def ignite_stored(spark: SparkSession, d: str) -> DataFrame:
    """Ignition from an index stored by term: English documents come later, as a change, and the stores are compacted."""
    docs = table(spark, d, "documents")
    late = F.coalesce(F.col("lang") == "en", F.lit(False))
    counts, n = tfidf.counted(docs.filter(~late)), docs.count()
    store = TermStore.create(counts, docs.filter(~late).count(), new_folder(spark, "terms"), max(16, n // DOCS_OF_A_BUCKET))
    fresh = docs.filter(late)
    store.add(counts.limit(0), tfidf.counted(fresh), fresh.select(F.col("doc_id").alias("node")), n)
    return store.compact(new_folder(spark, "terms")).ignite(QUERY).select("node", r6("a").alias("a"))


@register("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT vec_id AS chunk, vec_id AS first, vec_id + vec_id * vec_id % 11 AS "end" FROM embeddings),
i AS (SELECT chunk, vec_id, v FROM c JOIN v ON vec_id >= first AND vec_id < "end"),
p AS (SELECT x.chunk, avg(list_cosine_similarity(x.v, y.v)) AS s FROM i x JOIN i y ON x.chunk = y.chunk AND x.vec_id < y.vec_id GROUP BY x.chunk)
SELECT chunk, (SELECT count(*) FROM i WHERE i.chunk = c.chunk) AS n, round(coalesce((SELECT s FROM p WHERE p.chunk = c.chunk), 1.0), 5) AS coherence FROM c""")
def coherence_in_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Chunks from every vector on, of 0 to 9 vectors, so they overlap and some are empty."""
    rows = table(spark, d, "embeddings")
    i = F.col("vec_id").cast("long")
    vectors = rows.select(i.alias("pos"), F.col("embedding").cast("array<double>").alias("v"))
    chunks = rows.select(i.alias("chunk"), i.alias("first"), (i + i * i % 11).alias("end"))
    return metrics.range_coherence(vectors, chunks).select(F.col("chunk").cast(rows.schema["vec_id"].dataType).alias("chunk"), "n", F.round("coherence", 5).alias("coherence"))


@register(f"""WITH RECURSIVE {inp.DOC_SQL}, pairs AS (SELECT doc_id AS start, doc_id * 2 + 3 AS goal FROM documents),
walk(start, goal, node, hops, path) AS (
  SELECT start, goal, start, 0, [start] FROM pairs
  UNION ALL SELECT start, goal, dst, hops + 1, list_append(path, dst) FROM walk JOIN e ON src = node WHERE hops < 4 AND node <> goal AND NOT list_contains(path, dst))
SELECT start, goal, hops, array_to_string(path, '>') AS path FROM walk WHERE node = goal QUALIFY row_number() OVER (PARTITION BY start, goal ORDER BY hops, walk.path) = 1""")
def paths_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths of up to four hops from every document to the one of twice its number and three."""
    i = F.col("doc_id")
    pairs = table(spark, d, "documents").select(i.alias("start"), (i * 2 + 3).alias("goal"))
    return graph.paths(inp.doc_graph(spark, d), pairs, 4).withColumn("path", F.array_join("path", ">"))


@register("""SELECT user_id AS node, count(*) AS n, epoch_us(max(ts)) // 1000 AS last_ms, epoch_us(max(ts)) // 1000 + 3600000 > (SELECT epoch_us(max(ts)) // 1000 FROM events) AS alive FROM events GROUP BY user_id""")
def stream_keyed(spark: SparkSession, d: str) -> DataFrame:
    """Accesses by user in the state store of a stream; who was idle for an hour before the last event is no longer alive."""
    schema = table(spark, d, "events").schema
    return keyed.access_state(spark, d, "events.parquet", schema, "user_id", "ts", timedelta(hours=1))


@register(rf"""WITH {inp.WIKI_SQL}, t AS (SELECT path, body, list_distinct(list_transform(regexp_extract_all(body, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1), lambda x: lower(x))) AS links,
  regexp_extract(body, '(?m)^[ \t]*# +(\S.*?)[ \t\r]*$', 1) AS title FROM wiki),
f AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS folder FROM wiki),
b AS (SELECT folder, CASE WHEN folder = '' THEN 0 ELSE 1 << least(row_number() OVER (ORDER BY folder) - 1, 62) END AS bit FROM f)
SELECT path, sha256(body) AS body_sha256, 'title: ' || title || chr(10) || 'tokens: ' || greatest(1, strlen(body) // 4) || chr(10) || 'category: ' || bit || chr(10) AS head, CAST(len(links) AS INT) AS n_links
FROM t JOIN b ON folder = regexp_replace(path, '/?[^/]*$', '')""")
def markdown_folder(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a page and its sidecar in a folder, and both read back."""
    spark.dataSource.register(MarkdownFolder)
    pages = corpus.page_table(inp.wiki(spark, d).select("path", "body"))
    folder = new_folder(spark, "pages")
    sidecars = store.meta_text(pages)
    pages.select("page_id", "path", "body").join(sidecars, "page_id").select("path", "body", "meta").write.format("markdown").mode("append").save(folder)
    back = spark.read.format("markdown").load(folder)
    links = F.size(F.filter(F.split(F.regexp_extract("meta", r"(?s)links:\n(.*)$", 1), "\n"), lambda x: x.startswith("  - ")))
    return back.select("path", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"), F.regexp_extract("meta", r"(?s)^(.*)links:\n", 1).alias("head"), links.alias("n_links"))


@register("""WITH RECURSIVE s(i, v) AS (
  SELECT CAST(-1 AS BIGINT), CAST(12648430 AS UBIGINT)
  UNION ALL SELECT i + 1, xor(c, (c & ((CAST(1 AS UBIGINT) << 47) - 1)) << 17) FROM (SELECT i, xor(b, b >> 7) AS c FROM (SELECT i, xor(v, (v & ((CAST(1 AS UBIGINT) << 51) - 1)) << 13) AS b FROM s WHERE i + 1 < (SELECT count(*) FROM documents)))),
k AS (SELECT doc_id AS node, CAST(v % 7 AS INT) AS cluster FROM documents JOIN s ON i = doc_id)
SELECT node, cluster, lead(node) OVER (PARTITION BY cluster ORDER BY node) AS next FROM k""")
def planted_chains(spark: SparkSession, d: str) -> DataFrame:
    """Documents drawn into seven chains by one sequence of random numbers."""
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("node"))
    return randoms.planted(ids, 0xC0FFEE, 7, ids.count())


# ---- traces and small readers --------------------------------------------------------------------------------------


def trace_sql(f: str, k: int) -> str:
    parts = " UNION ALL ".join(f"SELECT {i} AS step, sum(abs(coalesce(p.a, 0) - coalesce(q.a, 0))) AS l1 FROM a{i} p FULL JOIN a{i - 1} q USING (node)" for i in range(1, k + 1))
    return f"{spread_sql(f, k)} SELECT step, round(l1, 6) AS residual FROM ({parts})"


@register(trace_sql(SIGMOID, 12))
def residual_trace(spark: SparkSession, d: str) -> DataFrame:
    """The change of each of the first twelve steps."""
    done = spread.spread(inp.doc_graph(spark, d), seeds(spark), spread.sigmoid(), spread.Config(max_iter=12, epsilon=0.0, stepwise=True))
    return spark.createDataFrame([(i, r) for i, r in enumerate(done.residuals, 1)], "step int, residual double").withColumn("residual", r6("residual"))


@register(f"{spread_sql(HARD, 2)}, x AS (SELECT sum(abs(coalesce(p.a, 0) - coalesce(q.a, 0))) AS l1 FROM a2 p FULL JOIN a1 q USING (node)), y AS (SELECT 0.8 * sum(abs(coalesce(p.a, 0) - coalesce(q.a, 0))) AS l1 FROM a1 p FULL JOIN a0 q USING (node)) SELECT round(x.l1, 6) AS after, round(y.l1, 6) AS bound FROM x, y")
def contraction_hard(spark: SparkSession, d: str) -> DataFrame:
    """The distance of two activations after a step with the hard threshold, which need not shrink it."""
    e, s, f = inp.doc_graph(spark, d), seeds(spark), spread.hard()
    return spread.contraction(e, s, s, spread.step(e, s, s, f, 0.8), f).select(r6("after").alias("after"), r6("bound").alias("bound"))


@register(r"""SELECT doc_id, regexp_replace(regexp_replace(replace(coalesce(text, ''), '/', '-'), '-+', '-', 'g'), '^[- \t\n\x0B\f\r]+|[- \t\n\x0B\f\r]+$', '', 'g') AS name FROM documents""")
def safe_filenames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.safe_filename(F.coalesce("text", F.lit(""))).alias("name"))


@register("""WITH k AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT o_orderkey AS id, o_custkey AS docket_id, 'Case, "' || o_orderkey || '"' || chr(10) || o_orderpriority AS case_name, CAST(o_custkey % 5 AS BIGINT) AS citation_count FROM orders WHERE o_custkey IN (FROM k)""")
def docket_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Orders as clusters of the dockets of one segment's customers, through CSV files whose values hold line breaks."""
    dockets, clusters = new_folder(spark, "dockets"), new_folder(spark, "clusters")
    kept = {"header": True, "quote": '"', "escape": "\\", "quoteAll": True}
    table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("court_id")).write.csv(dockets, **kept)
    i = F.col("o_orderkey").cast("string")
    rows = table(spark, d, "orders").select(i.alias("id"), F.col("o_custkey").alias("docket_id"), F.concat(F.lit('Case, "'), i, F.lit('"\n'), "o_orderpriority").alias("case_name"), F.lit("c").alias("case_name_short"), F.lit("2020-01-01").alias("date_filed"), (F.col("o_custkey") % 5).alias("citation_count"), F.lit("P").alias("precedential_status"), i.alias("slug"))
    rows.write.csv(clusters, **kept)
    return bulk.clusters(spark, clusters, bulk.dockets(spark, dockets, "BUILDING")).select("id", "docket_id", "case_name", "citation_count")


@register("SELECT doc_id AS pageid, source || ' ' || doc_id AS title, text AS wikitext, 2 AS n FROM documents WHERE source IS NOT NULL AND text IS NOT NULL")
def wiki_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the lines of a wiki export, read back; bad lines are skipped."""
    folder = new_folder(spark, "wiki")
    rows = table(spark, d, "documents").filter("source IS NOT NULL AND text IS NOT NULL")
    lines = rows.select(F.to_json(F.struct(F.col("doc_id").alias("pageid"), F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("wikitext"), F.array(F.lit("a"), F.col("lang")).alias("categories"))).alias("value"))
    lines.unionByName(lines.limit(1).select(F.lit('{"pageid": 1, "title": "cut').alias("value"))).write.text(folder, compression="gzip")
    return bulk.wiki_records(spark, folder).select("pageid", "title", "wikitext", F.size("categories").alias("n"))
