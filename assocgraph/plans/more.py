"""Queries over maintenance, metrics, retrieval, bulk transforms, page changes, generators and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import render
from ..functions import text as tx
from ..operators import etl, generate, graph, metrics, pages, retrieve, similar, spread, temporal, tfidf
from ..session import durable, stored, table
from ..streaming import access
from . import inputs as inp
from .core import GREEDY_SQL, HARD, IGNITE_SQL, MARKUP_SQL, QUERY, REACH_SQL, SIGMOID, index, r6, register, slug_text

# ---- maintenance ---------------------------------------------------------------------------------------------------

STATE_SQL = """
days AS (SELECT day, CAST(row_number() OVER (ORDER BY day) AS BIGINT) AS step FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)),
seen AS (SELECT user_id AS node, step, count(*) AS n FROM events JOIN days ON day = CAST(ts AS DATE) GROUP BY ALL),
now AS (SELECT max(step) AS now FROM days),
state AS (SELECT node, max(step) AS last_access, node % 11 <> 0 AS alive FROM seen GROUP BY node)
"""


def access_log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    """state, history and the last step of the events: a step is a day, an activation a thousandth of a user's events."""
    events = table(spark, d, "events").select(F.col("user_id").alias("node"), F.to_date("ts").alias("day"))
    days = events.select("day").distinct().withColumn("step", F.row_number().over(Window.orderBy("day")).cast("long"))  # a row for each day
    seen = durable(events.join(F.broadcast(days), "day").groupBy("node", "step").agg(F.count("*").alias("n")))
    state = seen.groupBy("node").agg(F.max("step").alias("last_access")).withColumn("alive", F.col("node") % 11 != 0)
    return state, seen.select("step", "node", (F.col("n") / 1000.0).alias("a")), int(days.agg(F.max("step").alias("m")).first().m)


@register(f"WITH {STATE_SQL} SELECT node, greatest(0, now - last_access) AS recency FROM state, now")
def recency(spark: SparkSession, d: str) -> DataFrame:
    state, _, now = access_log(spark, d)
    return temporal.recency(state, now)


@register(f"""WITH {STATE_SQL}, {inp.SESSION_SQL},
x AS (SELECT src, dst, g.raw_w * exp(-0.05 * greatest(0, now - last_access)) AS raw_w FROM g JOIN state ON node = src, now)
SELECT src, dst, round(raw_w, 6) AS raw_w, round(raw_w / sum(raw_w) OVER (PARTITION BY src), 6) AS w FROM x""")
def decay(spark: SparkSession, d: str) -> DataFrame:
    state, _, now = access_log(spark, d)
    return temporal.decay(inp.session_graph(spark, d), state, now).select("src", "dst", r6("raw_w").alias("raw_w"), r6("w").alias("w"))


@register(f"""WITH {STATE_SQL}
SELECT node FROM state, now WHERE alive AND coalesce((SELECT max(n) FROM seen WHERE seen.node = state.node AND step > now - 5), 0) < 4 AND now >= 5""")
def prune(spark: SparkSession, d: str) -> DataFrame:
    state, history, now = access_log(spark, d)
    return temporal.prune_candidates(state, history, now, 0.004, 5)


def dream_sql(threshold: float) -> str:
    """Common table expressions: s (cosines of all pairs above the threshold) and dreams (both ways, where no edge is)."""
    return f"""{inp.TOKENS_SQL}, {inp.DOC_SQL},
dot AS (SELECT x.node AS i, y.node AS j, sum(x.w * y.w) AS dot FROM p x JOIN p y ON y.node > x.node AND y.term = x.term GROUP BY ALL),
s AS (SELECT i, j, dot / (a.norm * b.norm) AS s FROM dot JOIN nrm a ON a.node = i JOIN nrm b ON b.node = j WHERE dot / (a.norm * b.norm) > {threshold}),
dreams AS (SELECT * FROM (SELECT i AS src, j AS dst, s FROM s UNION ALL SELECT j, i, s FROM s) x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.src = x.src AND g.dst = x.dst))"""


ALIVE_SQL = "alive AS (SELECT doc_id AS node FROM documents WHERE source IS DISTINCT FROM 'src1')"


def doc_state(spark: SparkSession, d: str) -> DataFrame:
    """Every document but those of one source is alive, none was accessed yet."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("last_access"), (~F.col("source").eqNullSafe("src1")).alias("alive"))


def living_pairs(spark: SparkSession, d: str, threshold: float) -> DataFrame:
    """The similar pairs of living documents, weighted among all."""
    posts = stored("posts", index(spark, d)[2])
    living = posts.join(temporal.sent(doc_state(spark, d).filter("alive").select("node")), "node", "left_semi")
    return similar.similar_pairs(living, tfidf.norms(living), threshold)


def dreamed(spark: SparkSession, d: str, threshold: float) -> DataFrame:
    sims = living_pairs(spark, d, threshold)
    return temporal.dream_candidates(inp.doc_edges(spark, d), doc_state(spark, d), sims, threshold, once=True).select("src", "dst", r6("s").alias("s"))


DREAM_SQL = "SELECT src, dst, round(s, 6) AS s FROM dreams WHERE src IN (FROM alive) AND dst IN (FROM alive)"


@register(f"WITH {dream_sql(0.5)}, {ALIVE_SQL} {DREAM_SQL}")
def dream(spark: SparkSession, d: str) -> DataFrame:
    """Links that a maintenance cycle dreams of: among all pairs, above its usual threshold."""
    return dreamed(spark, d, 0.5)


@register(f"WITH {dream_sql(0.3)}, {ALIVE_SQL} {DREAM_SQL}")
def dream_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same with a low threshold: many more pairs."""
    return dreamed(spark, d, 0.3)


def probe_sql(k: int, edges: str, alive: str) -> str:
    """Common table expressions for k linear steps from the first ten living nodes; a<k> is the last."""
    parts = [f"probes AS MATERIALIZED (SELECT node AS probe, node, 1.0::DOUBLE AS a FROM {alive} ORDER BY node LIMIT 10), pa0 AS (SELECT * FROM probes)"]
    for i in range(1, k + 1):
        parts.append(f"pf{i} AS (SELECT probe, dst AS node, 0.8 * sum(w * a) AS flow FROM {edges} JOIN pa{i - 1} ON src = node GROUP BY probe, dst), pa{i} AS MATERIALIZED (SELECT probe, node, coalesce(0.2 * s.a, 0) + coalesce(flow, 0) AS a FROM probes s FULL JOIN pf{i} USING (probe, node))")
    return ", ".join(parts)


def health_sql(alive: str, k: int = 50) -> str:
    return f"(SELECT count(DISTINCT node) FROM pa{k} WHERE a > 0.01 AND node IN (SELECT node FROM {alive})) / (SELECT count(*) FROM {alive})"


@register(f"WITH {inp.DOC_SQL}, {ALIVE_SQL}, {probe_sql(50, 'e', 'alive')} SELECT round({health_sql('alive')}, 6) AS health")
def health(spark: SparkSession, d: str) -> DataFrame:
    return temporal.health(inp.doc_graph(spark, d), doc_state(spark, d)).select(r6("health").alias("health"))


def linear_sql(k: int) -> str:
    """k linear steps from even activation; la<k> is the last."""
    parts = ["la0 AS MATERIALIZED (SELECT doc_id AS node, 1.0::DOUBLE / (SELECT count(*) FROM documents) AS a FROM documents)"]
    for i in range(1, k + 1):
        parts.append(f"lf{i} AS (SELECT dst AS node, 0.8 * sum(w * a) AS flow FROM e JOIN la{i - 1} ON src = node GROUP BY dst), la{i} AS MATERIALIZED (SELECT node, coalesce(0.2 * s.a, 0) + coalesce(flow, 0) AS a FROM la0 s FULL JOIN lf{i} USING (node))")
    return ", ".join(parts)


CYCLE_SQL = f"""{dream_sql(0.5)}, {linear_sql(85)},
st AS (SELECT doc_id AS node, CASE WHEN a > 0.002 THEN 1 ELSE 0 END AS last_access FROM documents JOIN la85 ON node = doc_id),
{ALIVE_SQL},
dec AS (SELECT src, dst, raw_w * exp(-0.05 * (1 - last_access)) AS raw_w FROM g JOIN st ON node = src),
un AS (SELECT src, dst, sum(raw_w) AS raw_w FROM (SELECT * FROM dec UNION ALL SELECT src, dst, 0.5 FROM dreams WHERE src IN (FROM alive) AND dst IN (FROM alive)) GROUP BY ALL),
ne AS MATERIALIZED (SELECT src, dst, raw_w, raw_w / sum(raw_w) OVER (PARTITION BY src) AS w FROM un)"""


def one_cycle(spark: SparkSession, d: str) -> temporal.Cycle:
    """A whole maintenance cycle over the documents: even activation, all similar pairs, ten probes of fifty steps."""
    n = table(spark, d, "documents").count()
    start = table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.lit(1.0 / max(1, n)).alias("a"))
    history = spark.createDataFrame([], "step long, node long, a double")
    config = temporal.Config(activation_threshold=0.002)
    return temporal.cycle(inp.doc_graph(spark, d), doc_state(spark, d), history, start, living_pairs(spark, d, config.similarity_threshold), 1, config, once=True)


@register(f"WITH {CYCLE_SQL} SELECT src, dst, round(raw_w, 6) AS raw_w, round(w, 6) AS w FROM ne")
def maintain(spark: SparkSession, d: str) -> DataFrame:
    """The edges after one maintenance cycle. Documents whose activation passed 0.002 count as accessed."""
    return one_cycle(spark, d).edges.select("src", "dst", r6("raw_w").alias("raw_w"), r6("w").alias("w"))


# ---- metrics -------------------------------------------------------------------------------------------------------

FOUND_SQL = "f AS (SELECT doc_id AS item FROM documents ORDER BY n_chars DESC, doc_id LIMIT 300), r AS (SELECT doc_id AS item FROM labels WHERE quality = 1)"


@register(f"""WITH {FOUND_SQL}, x AS (SELECT (SELECT count(*) FROM r SEMI JOIN f USING (item)) / (SELECT count(*) FROM r) AS recall, (SELECT count(*) FROM f SEMI JOIN r USING (item)) / (SELECT count(*) FROM f) AS precision)
SELECT round(recall, 6) AS recall, round(precision, 6) AS precision, round(CASE WHEN recall + precision = 0 THEN 0 ELSE 2 * recall * precision / (recall + precision) END, 6) AS f1 FROM x""")
def recall_precision_f1(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(300).select(F.col("doc_id").alias("item"))
    relevant = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("item"))
    return metrics.recall_precision(found, relevant).select(*[r6(c).alias(c) for c in ("recall", "precision", "f1")])


@register(f"{REACH_SQL} SELECT hop, round(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*), 6) AS recall FROM r LEFT JOIN labels ON doc_id = node GROUP BY hop")
def hop_recall(spark: SparkSession, d: str) -> DataFrame:
    relevant = graph.hops(inp.doc_graph(spark, d), 0).withColumnRenamed("node", "item")
    found = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("item"))
    return metrics.hop_recall(found, relevant).select("hop", r6("recall").alias("recall"))


@register("""WITH v AS (SELECT vec_id // 10 AS chunk, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT x.chunk, list_cosine_similarity(x.v, y.v) AS s FROM v x JOIN v y ON x.chunk = y.chunk AND x.vec_id < y.vec_id),
c AS (SELECT chunk, coalesce((SELECT avg(s) FROM p WHERE p.chunk = v.chunk), 1.0) AS c FROM v GROUP BY chunk)
SELECT chunk, round(c, 5) AS coherence FROM c""")
def coherence(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.expr("vec_id DIV 10").alias("chunk"), F.col("embedding").cast("array<double>").alias("v"))
    return metrics.coherence(vectors).select("chunk", F.round("coherence", 5).alias("coherence"))


@register(f"WITH {inp.ITEMS_SQL} SELECT round(var_pop(score / cost), 4) AS variance FROM items WHERE score > 0")
def density_variance(spark: SparkSession, d: str) -> DataFrame:
    return metrics.density_variance(inp.items(spark, d)).select(F.round("variance", 4).alias("variance"))


@register("SELECT round(avg(l_quantity), 6) AS avg, min(l_quantity) AS low, max(l_quantity) AS high, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95, quantile_disc(l_quantity, 0.99) AS p99 FROM lineitem")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.percentiles(table(spark, d, "lineitem"), "l_quantity").withColumn("avg", r6("avg"))


@register("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS item, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS s FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 10""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("v"))
    query = vectors.filter("item = 0").select(F.col("v").alias("q"))
    return metrics.nearest(vectors, query, 10).select("item", r6("s").alias("s"))


# ---- retrieval -----------------------------------------------------------------------------------------------------


def retrieval_sql(k: int, budget: int, f: str = SIGMOID) -> str:
    """RECURSIVE common table expressions for k steps from the ignited documents and the greedy walk."""
    parts = [f"{IGNITE_SQL}, {inp.DOC_SQL}"]
    for i in range(1, k + 1):
        parts.append(f"f{i} AS (SELECT dst AS node, 0.8 * sum(w * fa) AS flow FROM e JOIN (SELECT node AS src, {f} AS fa FROM a{i - 1}) USING (src) WHERE fa <> 0 GROUP BY dst), a{i} AS MATERIALIZED (SELECT node, coalesce(0.2 * a0.a, 0) + coalesce(flow, 0) AS a FROM a0 FULL JOIN f{i} USING (node))")
    items = f"items AS MATERIALIZED (SELECT node AS item, round(a, 6) AS score, CAST(greatest(1, strlen(coalesce(text, '')) // 4) AS BIGINT) AS cost FROM a{k} JOIN documents ON doc_id = node)"
    return GREEDY_SQL.replace("RECURSIVE {items}", "RECURSIVE {parts}, {items}").format(parts=", ".join(parts), items=items, budget=budget)


def retrieved(spark: SparkSession, d: str, threshold: spread.Threshold | None = None) -> DataFrame:
    """Picks for the query, spread to the fixed point; scores count to six digits, so that equal ones tie."""
    counts, df, posts, n = index(spark, d)
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("node"), tx.token_cost(F.col("text")).alias("cost"))
    asked = tfidf.asked_postings(counts, df, durable(tfidf.query_vector(df, QUERY, n)), n)
    return retrieve.query(QUERY, asked, df, tfidf.norms(posts), n, inp.doc_graph(spark, d), nodes, threshold=threshold, digits=6).picks


@register(f"WITH {retrieval_sql(40, 4000)} SELECT CAST(row_number() OVER (ORDER BY r) AS INT) AS pick_rank, item, score, cost FROM walk WHERE took")
def retrieve_pages(spark: SparkSession, d: str) -> DataFrame:
    """Converged within 1e-8, so forty fixed steps give the same six digits."""
    return retrieved(spark, d)


@register(f"WITH {retrieval_sql(85, 4000, HARD)} SELECT CAST(row_number() OVER (ORDER BY r) AS INT) AS pick_rank, item, score, cost FROM walk WHERE took")
def retrieve_hard(spark: SparkSession, d: str) -> DataFrame:
    """With a hard threshold, under which a step shrinks distances by 0.8 at best."""
    return retrieved(spark, d, spread.hard())


# ---- bulk transforms -----------------------------------------------------------------------------------------------

CITATION_SQL = """
wanted AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0),
c AS (SELECT o_custkey AS src, CAST(p_size AS BIGINT) AS dst, CAST(sum(l_linenumber) AS BIGINT) AS depth
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
      WHERE o_custkey <> p_size AND o_custkey IN (FROM wanted) AND p_size IN (FROM wanted) GROUP BY ALL)
"""


def cited(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"), F.col("l_linenumber").cast("long").alias("depth"))
    citing_map = table(spark, d, "orders").select(F.col("o_orderkey").alias("opinion"), F.col("o_custkey").alias("cluster"))
    cited_map = table(spark, d, "part").select(F.col("p_partkey").alias("opinion"), F.col("p_size").cast("long").alias("cluster"))
    wanted = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("cluster"))
    return etl.aggregate_citations(lines, citing_map, cited_map, wanted)


@register(f"WITH {CITATION_SQL} SELECT src, dst, depth FROM c")
def citation_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return cited(spark, d)


@register(f"WITH {CITATION_SQL} SELECT src, dst, depth, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY depth DESC, dst) AS r FROM c) WHERE r <= 5")
def top_citations(spark: SparkSession, d: str) -> DataFrame:
    return etl.top_citations(cited(spark, d), 5)


@register(f"""WITH {CITATION_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY depth DESC, dst) AS r FROM c)
SELECT src, string_agg('- [[size-' || dst || '|Size ' || dst || ']]' || CASE WHEN depth > 1 THEN ' ×' || depth ELSE '' END, chr(10) ORDER BY r) AS md FROM t WHERE r <= 5 GROUP BY src""")
def citation_lists(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "part").select(F.col("p_size").cast("long").alias("cluster")).distinct()
    names = sizes.select("cluster", F.concat(F.lit("size-"), F.col("cluster").cast("string")).alias("page_id"), F.concat(F.lit("Size "), F.col("cluster").cast("string")).alias("name"))
    return etl.citation_list(cited(spark, d), names, 5)


@register("SELECT o_orderkey AS opinion, o_custkey AS cluster FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def opinion_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("cluster_id"))
    wanted = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("cluster"))
    return etl.project(rows, wanted)


@register("""WITH x AS (SELECT conv_id, turn, text, CASE role WHEN 'system' THEN '020lead' WHEN 'user' THEN '040dissent' ELSE '030concurrence' END AS type FROM conversations)
SELECT conv_id AS cluster, string_agg('## ' || CASE type WHEN '020lead' THEN 'Opinion' WHEN '040dissent' THEN 'Dissent' ELSE 'Concurrence' END || chr(10) || chr(10) || text, chr(10) || chr(10)
  ORDER BY CASE type WHEN '020lead' THEN 0 WHEN '030concurrence' THEN 2 ELSE 3 END, turn, text) AS body FROM x GROUP BY conv_id""")
def section_bodies(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "system", "020lead").when(F.col("role") == "user", "040dissent").otherwise("030concurrence")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("cluster"), F.col("turn").alias("id"), kind.alias("type"), F.col("text").alias("md"))
    return etl.sections(rows)


@register("""SELECT doc_id, slug FROM (SELECT doc_id, slug, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS r FROM (
  SELECT doc_id, text, coalesce(nullif(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'case') AS slug FROM documents)
  WHERE NOT starts_with(lower(ltrim(text)), '#redirect [[')) WHERE r = 1""")
def first_per_slug(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "documents").select("doc_id", "text", tx.slug(slug_text(F.col("text"))).alias("slug"))
    return etl.first_of_each(records, "slug", "doc_id").select("doc_id", "slug")


@register("SELECT doc_id AS node, n_chars AS citations FROM documents WHERE strlen(text) >= 2048 ORDER BY n_chars DESC, doc_id LIMIT 40")
def landmarks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.col("text").alias("body"), F.col("n_chars").alias("citations"))
    return etl.landmarks(docs, 40).select("node", "citations")


# ---- page changes --------------------------------------------------------------------------------------------------


@register("""WITH old AS (SELECT DISTINCT doc_id AS src, dst, 3.0::DOUBLE AS raw_w FROM (SELECT doc_id, unnest([doc_id + 1, doc_id * 2]) AS dst FROM documents) WHERE doc_id <> dst AND dst IN (SELECT doc_id FROM documents))
SELECT src, dst, raw_w FROM old
UNION ALL SELECT doc_id, 1, 1.0 FROM documents WHERE doc_id <> 1 AND NOT EXISTS (SELECT 1 FROM old WHERE src = doc_id AND dst = 1)""")
def update_links(spark: SparkSession, d: str) -> DataFrame:
    """Every page is changed to link to page 1, too; its other links keep their weight."""
    wiki = inp.wiki(spark, d)
    rows = wiki.select("node", tx.page_id(F.col("path")).alias("page_id"), "body")
    old = graph.from_links(rows.select("node", "page_id", tx.links(F.col("body")).alias("links_to"))).withColumn("raw_w", F.lit(3.0))
    one = rows.filter("node = 1").select(F.concat(F.lit(" [["), "page_id", F.lit("]]")).alias("more"))
    changed = rows.crossJoin(F.broadcast(one)).select("node", F.concat("body", "more").alias("body"))  # one row
    return pages.relink(old, rows.select("node", "page_id"), changed)


SECTION = "\n\n## See Also\n- [[old/one]]\n\n## Notes\nlast words"


@register(f"""WITH {inp.WIKI_SQL} SELECT lower(regexp_replace(path, '\\.[^./]*$', '')) AS page_id,
CASE WHEN lang = 'en' THEN body || chr(10) || chr(10) || '## See Also' || chr(10) || '- [[old/one]]' || chr(10) || chr(10) || '- [[target/a]]' || chr(10) || '- [[target/b]]' || chr(10) || '## Notes' || chr(10) || 'last words'
     ELSE body || chr(10) || chr(10) || '## See Also' || chr(10) || chr(10) || '- [[target/a]]' || chr(10) || chr(10) || '- [[target/b]]' END AS body FROM wiki""")
def backlinks(spark: SparkSession, d: str) -> DataFrame:
    """Two links back for every page; English pages have a section for them already, before another one."""
    body = F.when(F.col("lang") == "en", F.concat("body", F.lit(SECTION))).otherwise(F.col("body")).alias("body")
    rows = inp.wiki(spark, d).select(tx.page_id(F.col("path")).alias("page_id"), body)
    links = rows.select("page_id", F.explode(F.array(F.lit("target/b"), F.lit("target/a"))).alias("target"))
    return pages.add_backlinks(rows, links)


@register(f"WITH {inp.WIKI_SQL} SELECT node, lower(regexp_replace(path, '\\.[^./]*$', '')) AS page_id, CAST(CASE WHEN node = 1 THEN 0.51 ELSE 0.52 END AS DOUBLE) AS priority FROM wiki")
def sitemap(spark: SparkSession, d: str) -> DataFrame:
    rows = inp.wiki(spark, d).select("node", tx.page_id(F.col("path")).alias("page_id"), tx.links(F.col("body")).alias("links_to"))
    return pages.sitemap(rows).join(rows.select("node", "page_id"), "page_id").select("node", "page_id", "priority")


# ---- generators and streams ----------------------------------------------------------------------------------------


@register("SELECT CAST(0 AS BIGINT) AS src, range AS dst, 'star' AS kind FROM range(1, 50) UNION ALL SELECT range, range + 1, 'chain' FROM range(49) UNION ALL SELECT a.range, b.range, 'clique' FROM range(12) a, range(12) b WHERE a.range <> b.range")
def generated_graphs(spark: SparkSession, d: str) -> DataFrame:
    return generate.star(spark, 50).withColumn("kind", F.lit("star")).unionByName(generate.chain(spark, 50).withColumn("kind", F.lit("chain"))).unionByName(generate.clique(spark, 12).withColumn("kind", F.lit("clique")))


@register("SELECT user_id AS node, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY user_id")
def stream_access(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return access.access_state(spark, d, "events.parquet", schema, "user_id", "ts").select("node", "n", "last_ts")


# ---- markup with links, rendering, a plain vector search -------------------------------------------------------------

ESCAPED_SQL = "replace(replace(replace(replace(replace(plain, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"


@register(rf"""WITH t AS (SELECT doc_id AS node, trim(regexp_replace(translate(coalesce(text, ''), '*[]#', '....'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS plain FROM documents)
SELECT node, '<h2>Doc ' || node || '</h2>' || chr(10) || CASE WHEN plain = '' THEN '' ELSE '<p>' || {ESCAPED_SQL} || '</p>' || chr(10) END ||
  '<ul>' || chr(10) || '  <li><strong>' || node || '</strong></li>' || chr(10) || '  <li><a href="/w/main/a%20b%2F' || node || '">next &amp; last</a></li>' || chr(10) || '</ul>' || chr(10) ||
  '<p>so <em>see</em> <a href="http://x.org/?a=1&amp;b=2" rel="nofollow noopener" target="_blank">site</a> [open **not bold**</p>' || chr(10) AS html FROM t""")
def rendered_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a page of markdown (its own marks made plain), rendered as HTML."""
    i = F.col("doc_id").cast("string")
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "*[]#", "...."), r"\s+", " "))
    text = F.concat(F.lit("# Doc "), i, F.lit("\n\n"), plain, F.lit("\n\n* **"), i, F.lit("**\n * [[ a b/"), i, F.lit(" | next & last ]]\n\nso *see* [site](http://x.org/?a=1&b=2) [open **not bold**"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("node"), render.body(text).alias("html"))

ANCHOR_SQL = r"""(?is)<a\b[^>]*?href=[\x22''](?:[^\x22'']*)[\x22''][^>]*>(?:.*?)</a>"""


@register(
    MARKUP_SQL.replace("FROM pages", "FROM linked").replace(
        "WITH a AS",
        rf"""WITH x AS (SELECT page_id, regexp_split_to_array(html, '{ANCHOR_SQL}') AS p, regexp_extract_all(html, '{ANCHOR_SQL}') AS a FROM (SELECT page_id, html || '<p><a href="/known">see [1] a|b</a> <a href="/known"> </a></p>' AS html FROM pages)),
y AS (SELECT page_id, p, list_transform(a, lambda s: struct_pack(k := regexp_extract(s, 'href="/([^"]*)"', 1), t := trim(regexp_replace(regexp_extract(s, '>(.*)</a>', 1), '<[^>]*>', '', 'g')))) AS a FROM x),
z AS (SELECT page_id, p, list_transform(a, lambda s: CASE WHEN length(s.k) > 3 THEN '[[w-' || lower(s.k) || '|' || coalesce(nullif(translate(s.t, '|[]', ' ()'), ''), 'w-' || lower(s.k)) || ']]' ELSE s.t END) AS a FROM y),
linked AS (SELECT page_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(a[i], '')), '') AS html FROM z),
a AS""",
    )
)
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Anchors to words of more than three letters have a page; every page gets two with a label of brackets and with none."""
    html = table(spark, d, "pages").select(F.col("page_id").alias("node"), F.concat("html", F.lit('<p><a href="/known">see [1] a|b</a> <a href="/known"> </a></p>')).alias("html"))
    words = html.select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("key")).distinct().filter(F.length("key") > 3)
    targets = words.select("key", F.concat(F.lit("w-"), F.lower("key")).alias("page_id"))
    return etl.linked_markup(html, targets, r"^/([^\x22]*)$").withColumnRenamed("node", "page_id")


@register(r"""WITH q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest(regexp_extract_all(lower('QUERY'), '[\p{L}\p{N}_]{2,}')) AS term) GROUP BY term),
tf AS (SELECT doc_id AS item, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY ALL),
df AS (SELECT term, count(*) + CASE WHEN term IN (SELECT term FROM q) THEN 1 ELSE 0 END AS df FROM tf GROUP BY term),
w AS (SELECT item, term, tf * (ln((2.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w, qtf * (ln((2.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS q FROM tf JOIN df USING (term) LEFT JOIN q USING (term)),
l AS (SELECT sqrt(sum(pow(qtf * (ln((2.0 + (SELECT count(*) FROM documents)) / (1 + coalesce(df, 1))) + 1), 2))) AS l FROM q LEFT JOIN df USING (term))
SELECT item, round(sum(w * q) / sqrt(sum(w * w)) / any_value(l), 6) AS s FROM w, l GROUP BY item HAVING sum(w * q) > 0 ORDER BY sum(w * q) / sqrt(sum(w * w)) DESC, item LIMIT 20""".replace("QUERY", QUERY))
def baseline_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item"), "text")
    return metrics.baseline_topk(docs, QUERY, 20).withColumn("s", r6("s"))


@register(f"""WITH {inp.TOKENS_SQL}, s AS (SELECT x.node AS i, y.node AS j, sum(x.w * y.w) AS dot FROM p x JOIN p y ON x.term = y.term AND x.node < y.node GROUP BY ALL)
SELECT i, j, round(dot / (a.norm * b.norm), 6) AS s FROM s JOIN nrm a ON a.node = i JOIN nrm b ON b.node = j WHERE dot / (a.norm * b.norm) > 0.6""")
def similar_documents(spark: SparkSession, d: str) -> DataFrame:
    posts = stored("posts", index(spark, d)[2])
    return similar.similar_pairs(posts, tfidf.norms(posts), 0.6).select("i", "j", r6("s").alias("s"))
