"""Queries over markup, page heads and files that are written and read back, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import etl
from ..session import new_folder, table
from ..sources import bulk, corpus, store
from . import inputs as inp
from .core import register
from .more import CITATION_SQL, cited

# ---- markup ----------------------------------------------------------------------------------------------------------

WIKITEXT_SQL = r"""
WITH s0 AS (SELECT doc_id, '== ' || coalesce(source, '') || chr(10) || '===' || chr(10) || '=== ' || lang || ' === ' || chr(10) || chr(10) || '{{cite {{x|{{y}}}} z}}<ref name=a>b</ref><!-- c -->' || coalesce(text, '') || chr(10) ||
  '  ''''''bold'''''' ''''it'''' LINKS [http://a.b/c d e] [https://f.g] <br/>{| t |}' AS t FROM documents),
s1 AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', '', 'g'), '(?is)<ref\b[^>]*>.*?</ref>', '', 'g'), '(?i)<ref\b[^>]*/>', '', 'g') AS t FROM s0),
s2 AS (SELECT doc_id, regexp_replace(t, '(?s)\{\|.*?\|\}', '', 'g') AS t FROM s1),
s3 AS (SELECT doc_id, TEMPLATES AS t FROM s2),
s4 AS (SELECT doc_id, regexp_replace(t, '(?i)</?(?:small|big|sup|sub|code|nowiki|br|hr)\b[^>]*>', '', 'g') AS t FROM s3),
s5 AS (SELECT doc_id, HEADINGS AS t FROM s4),
s6 AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?s)''''''(.+?)''''''', '**\1**', 'g'), '(?s)''''(.+?)''''', '*\1*', 'g') AS t FROM s5),
s7 AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\[(https?://\S+)\s+([^\]]+)\]', '[\2](\1)', 'g'), '\[(https?://\S+)\]', '\1', 'g') AS t FROM s6),
s8 AS (SELECT doc_id, replace(t, ' LINKS', ' [[doc-' || doc_id || '|own page]] [[doc-' || doc_id || ']]  gone up') AS t FROM s7)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^[ \t]+', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\A\s+|\s+\z', '', 'g') AS md FROM s8"""
_nested, _levels = "t", "t"
for _ in range(6):
    _nested = f"regexp_replace({_nested}, '\\{{\\{{[^{{}}]*\\}}\\}}', '', 'g')"
for _level in (6, 5, 4, 3, 2):
    _levels = f"regexp_replace({_levels}, '(?m)^={{{_level}}}\\s*(.+?)\\s*={{{_level}}}\\s*$', '{'#' * _level} \\1', 'g')"


@register(WIKITEXT_SQL.replace("TEMPLATES", _nested).replace("HEADINGS", _levels))
def wikitext_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts between markup of every kind; the titles of the pages are `Doc <id>`."""
    docs = table(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    links = F.concat(F.lit(" [[Doc "), i, F.lit("#part|own page]] [[doc "), i, F.lit("]] [[File:a.png|b]] [[No such page|gone]] [[#top|up]]"))
    front = F.concat(F.lit("== "), F.coalesce("source", F.lit("")), F.lit("\n===\n=== "), "lang", F.lit(" === \n\n{{cite {{x|{{y}}}} z}}<ref name=a>b</ref><!-- c -->"))
    back = F.concat(F.lit("\n  '''bold''' ''it''"), links, F.lit(" [http://a.b/c d e] [https://f.g] <br/>{| t |}"))
    pages = docs.select(F.col("doc_id").alias("node"), F.concat(front, F.coalesce("text", F.lit("")), back).alias("text"))
    return etl.wikitext_pages(pages, docs.select(F.concat(F.lit("Doc "), i).alias("title"))).withColumnRenamed("node", "doc_id")


@register(r"""WITH x AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)
SELECT conv_id, turn, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
       replace(replace(replace(replace(replace(t, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS json, url_encode(t) AS address FROM x""")
def escaped_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.html_escaped(t).alias("html"), tx.json_escaped(t).alias("json"), tx.percent_encoded(t).alias("address"))


# ---- heads and feet of pages -------------------------------------------------------------------------------------------


@register("""SELECT c_custkey AS cluster, '# ' || c_name || chr(10) || chr(10) || '*filed ' || first || ', ' || lower(c_mktsegment) || ', ' || n || ' incoming citations*' || chr(10) || chr(10) AS md
FROM customer JOIN (SELECT o_custkey, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
UNION ALL SELECT c_custkey, '# ' || c_name || chr(10) || chr(10) || '*' || lower(c_mktsegment) || '*' || chr(10) || chr(10) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def case_headers(spark: SparkSession, d: str) -> DataFrame:
    """Customers as cases: filed on the day of their first order, cited by all."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").cast("date").cast("string").alias("filed"), F.count("*").alias("n"))
    rows = table(spark, d, "customer").join(orders, "c_custkey", "left")
    md = etl.header(F.col("c_custkey"), F.lit(""), F.col("c_name"), F.col("filed"), F.col("c_mktsegment"), F.coalesce("n", F.lit(0)))
    return rows.select(F.col("c_custkey").alias("cluster"), md.alias("md"))


@register(f"""WITH {CITATION_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY depth DESC, dst) AS r FROM c)
SELECT src, '## Cites (' || count(*) || ')' || chr(10) || chr(10) || string_agg('- [[size-' || dst || '|Size ' || dst || ']]' || CASE WHEN depth > 1 THEN ' ×' || depth ELSE '' END || chr(10), '' ORDER BY r) || chr(10) AS md FROM t WHERE r <= 200 GROUP BY src""")
def citation_footers(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "part").select(F.col("p_size").cast("long").alias("cluster")).distinct()
    names = sizes.select("cluster", F.concat(F.lit("size-"), F.col("cluster").cast("string")).alias("page_id"), F.concat(F.lit("Size "), F.col("cluster").cast("string")).alias("name"))
    return etl.footer(cited(spark, d), names)


# ---- written files, read back ------------------------------------------------------------------------------------------


@register("SELECT o_orderkey AS id, o_custkey AS cluster_id, o_orderpriority AS type, 'a \"quoted\" <b>' || o_orderpriority || '</b>' || chr(10) || 'second line, ' || o_orderstatus AS html FROM orders")
def csv_opinions(spark: SparkSession, d: str) -> DataFrame:
    """A compressed CSV file with a header, quotes escaped by backslashes and line breaks in values."""
    folder = new_folder(spark, "opinions")
    html = F.concat(F.lit('a "quoted" <b>'), "o_orderpriority", F.lit("</b>\nsecond line, "), "o_orderstatus")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster_id"), F.col("o_orderpriority").alias("type"), html.alias("html_with_citations"))
    rows.write.csv(folder, header=True, quote='"', escape="\\", quoteAll=True, compression="bzip2")
    return bulk.opinions(spark, folder)


@register("SELECT l_orderkey AS citing, l_partkey AS cited, CAST(l_linenumber AS BIGINT) AS depth FROM lineitem")
def csv_citations(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "citations")
    rows = table(spark, d, "lineitem").select(F.lit(1).alias("id"), F.col("l_linenumber").alias("depth"), F.col("l_partkey").alias("cited_opinion_id"), F.col("l_orderkey").alias("citing_opinion_id"))
    rows.write.csv(folder, header=True, quoteAll=True)
    return bulk.citations(spark, folder)


@register(f"WITH {inp.SESSION_SQL} SELECT src, dst, CAST(raw_w AS INT) AS depth FROM g")
def edge_files(spark: SparkSession, d: str) -> DataFrame:
    """Edges as compressed CSV without a header."""
    folder = new_folder(spark, "edges")
    inp.session_edges(spark, d).select("src", "dst", F.col("raw_w").cast("int").alias("depth")).write.csv(folder, compression="gzip")
    return bulk.edge_list(spark, folder)


@register("SELECT o_orderkey AS id, o_custkey AS cid, o_orderpriority AS type, o_orderstatus AS html FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def opinion_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The bodies of wanted clusters as JSON lines, written beside the map of all opinions."""
    folder = new_folder(spark, "bodies")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster_id"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("html"))
    wanted = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("cluster"))
    bulk.write_bodies(rows, wanted, folder)
    return bulk.bodies(spark, f"{folder}/bodies")


@register("SELECT o_orderkey AS opinion, o_custkey AS cluster FROM orders")
def opinion_maps(spark: SparkSession, d: str) -> DataFrame:
    """The map that goes with the bodies."""
    folder = new_folder(spark, "maps")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster_id"), F.lit("t").alias("type"), F.lit("").alias("html"))
    bulk.write_bodies(rows, spark.createDataFrame([], "cluster long"), folder)
    return bulk.opinion_map(spark, f"{folder}/opinion_to_cluster")


@register("SELECT DISTINCT o_custkey AS cluster FROM orders")
def id_sets(spark: SparkSession, d: str) -> DataFrame:
    """One number a line, with repetitions and lines that are no numbers."""
    folder = new_folder(spark, "ids")
    lines = F.explode(F.array(F.concat(F.lit(" "), F.col("o_custkey").cast("string")), F.lit("none")))
    table(spark, d, "orders").select(lines.alias("value")).write.text(folder)
    return bulk.id_set(spark, folder)


@register("SELECT c_custkey AS cluster, c_name AS case_name, c_mktsegment AS case_name_short, CAST(c_nationkey AS BIGINT) AS citation_count FROM customer")
def cluster_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of clusters as JSON objects keyed by id, one object for each nation."""
    folder = new_folder(spark, "facts")
    facts = F.struct(F.col("c_name").alias("case_name"), F.col("c_mktsegment").alias("case_name_short"), F.col("c_nationkey").alias("citation_count"))
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), facts))).alias("m"))
    rows.select(F.to_json("m").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return bulk.cluster_meta(spark, folder).select("cluster", "case_name", "case_name_short", "citation_count")


@register(f"WITH {inp.WIKI_SQL} SELECT lower(regexp_replace(path, '\\.[^./]*$', '')) AS page_id, body FROM wiki")
def markdown_files(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "pages")
    bulk.write_markdown(inp.wiki(spark, d).select(tx.page_id(F.col("path")).alias("page_id"), "body"), folder)
    return spark.read.schema("page_id string, body string, prefix string").json(folder).select("page_id", "body")


@register(f"""WITH {inp.WIKI_SQL}, p AS (SELECT *, lower(regexp_replace(path, '\\.[^./]*$', '')) AS page_id FROM wiki)
SELECT node, page_id, row_number() OVER (ORDER BY page_id) - 1 AS place, CAST(greatest(1, strlen(body) // 4) AS BIGINT) AS token_cost,
       'title: ' || regexp_extract(body, '(?m)^[ \\t]*# +(\\S.*?)[ \\t\\r]*$', 1) AS meta FROM p""")
def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Pages numbered in the order of their ids, with the first line of their sidecar."""
    own = inp.wiki(spark, d).withColumnRenamed("node", "doc")
    rows = corpus.numbered(corpus.page_table(own.select("path", "body")))
    meta = store.meta_text(rows).select("page_id", F.substring_index("meta", "\n", 1).alias("meta"))
    ids = own.select("doc", tx.page_id(F.col("path")).alias("page_id"))
    return rows.join(meta, "page_id").join(ids, "page_id").select(F.col("doc").alias("node"), "page_id", F.col("node").alias("place"), "token_cost", "meta")
