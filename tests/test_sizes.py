"""Queries over graphs and texts that are larger or stranger than the given tables, against their SQL."""

import pytest

duckdb = pytest.importorskip("duckdb")

from test_queries import same  # noqa: E402

from assocgraph.operators import blocks  # noqa: E402
from assocgraph.plans import batch, core, files, joins, more  # noqa: E402,F401


def against_sql(spark, folder, rows, *names):
    """The queries over documents(doc_id, text, lang, source, n_chars) given as a SELECT of DuckDB, and over their SQL."""
    con = duckdb.connect()
    con.sql(f"COPY ({rows}) TO '{folder}/documents.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for name in names:
        same(core.QUERIES[name](spark, str(folder)), con.sql(core.ORACLES[name]))


NUMBERS = "SELECT range AS doc_id, 'text' AS text, 'en' AS lang, 's' AS source, 4 AS n_chars FROM range({})"


def test_fixed_point_has_all_nodes_that_thirty_steps_reach(spark, tmp_path):
    against_sql(spark, tmp_path, NUMBERS.format(40_000), "spread_fixed_point")


def test_residuals_are_those_of_steps_where_edges_fill_several_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 200)
    against_sql(spark, tmp_path, NUMBERS.format(300), "residual_trace", "spread_fixed_point")


def test_counts_of_odd_texts(spark):
    from assocgraph.operators import tfidf
    from pyspark.sql import functions as F

    from assocgraph.functions import text as tx

    texts = ["İstanbul ΑΣ'Α ΟΔΟΣ K kelvin K2", None, "", "the The THE of a I Ⅳ ① éÉ", "İ", "Σ σΣ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    each = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), tx.BREAKS), lambda t: F.octet_length(t) > 1), F.lower)
    want = {(r.doc_id, r.term): r["count"] for r in docs.select("doc_id", F.explode(each).alias("term")).groupBy("doc_id", "term").count().collect()}
    got = {(r.node, r.term): (r.tf, r.max_tf) for r in tfidf.counted(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(top == max(n for (d, _), n in want.items() if d == k[0]) for k, (_, top) in got.items())
    # rows of one id are one document
    twice = {(r.node, r.term): (r.tf, r.max_tf) for r in tfidf.counted(docs.withColumn("doc_id", F.lit(7))).collect()}
    assert twice[7, "the"] == (3, 3) and sum(v[0] for v in twice.values()) == sum(want.values())


def test_postings_stay_where_they_are(spark):
    """Frequent terms meet their frequencies without an exchange: of a plan's exchanges, none holds the counts of all terms by node."""
    from assocgraph.operators import tfidf
    from assocgraph.session import durable
    from pyspark.sql import functions as F

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common words"), F.concat(F.lit("rare"), "id")).alias("text"))
    counts = durable(tfidf.counted(docs))
    df = durable(tfidf.document_frequency(counts))
    plan = tfidf.postings(counts, df, 300)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning(node") == 0


def test_probes_of_a_graph_of_several_blocks(spark, tmp_path, monkeypatch):
    """Probes are columns there; twenty of them are two groups."""
    from pyspark.sql import functions as F

    from assocgraph.operators import temporal

    edges = spark.range(200).select(F.col("id").alias("src"), F.explode(F.array((F.col("id") * 2) % 200, (F.col("id") + 1) % 200)).alias("dst")).filter("src <> dst").distinct().withColumn("w", F.lit(0.5)).cache()
    probes = spark.range(20).select(F.col("id").alias("probe"))
    rows = lambda df: {(r.probe, r.node): round(r.a, 9) for r in df.collect()}
    want = rows(temporal.probe(edges, probes, 7))
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 50)
    assert rows(temporal.probe(edges, probes, 7)) == want and len(want) > 1000
    against_sql(spark, tmp_path, NUMBERS.format(300), "health")


def test_optima_of_groups_of_all_sizes_against_every_subset():
    """Equal sizes at once, beyond 20 items no masks; the greedy walk and the single item beside them."""
    import itertools
    import random

    import pyarrow as pa

    from assocgraph.operators import select

    rng, groups = random.Random(5), []
    for n in [0, 1, 2, 3, 7, 7, 9, 21]:
        items = [(float(rng.randint(0, 50)), rng.randint(1, 9)) for _ in range(n)]
        groups.append(sorted(items, key=lambda x: -x[0] / x[1]))
    lists = [pa.array([[x[k] for x in g] for g in groups], pa.list_(kind)) for k, kind in ((0, pa.float64()), (1, pa.int64()))]
    many, one, rooms, masks = (a.to_pylist() for a in select.worths_of(*lists, 12))
    for i, g in enumerate(groups):
        room, worth = 12, 0.0
        for score, cost in g:
            if cost <= room:
                room, worth = room - cost, worth + score
        assert many[i] == worth and one[i] == max((x[0] for x in g), default=0.0)
        if len(g) <= 9:
            subsets = itertools.chain.from_iterable(itertools.combinations(g, k) for k in range(len(g) + 1))
            assert rooms[i] == masks[i] == max(sum(x[0] for x in s) for s in subsets if sum(x[1] for x in s) <= 12)
    assert masks[-1] is None and rooms[-1] >= many[-1]


def test_wikitext_is_prepared_once(spark):
    """Links and pieces are taken from the stored text: what is left of the plan has no comment or template to take out."""
    from assocgraph.operators import etl

    pages = spark.createDataFrame([(1, "{{a {{b}} }}x<!-- c --> [[Two|t]] [[Other|o]]"), (2, None)], "node long, text string")
    found = etl.wikitext_pages(pages, spark.createDataFrame([("Two",)], "title string"))
    assert "<!--" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(1, "x [[two|t]] o"), (2, "")}


def test_slugs_of_texts_without_a_name(spark, tmp_path):
    """No text, an empty one, one of marks only, and the letter whose lower case is an i alone in SQL."""
    texts = ["NULL", "''", "'  '", "'!?'", "'éé'", "'İSTANBUL İ'", "'K elvin'", "'Roe v. Wade!!'", "repeat('ab ', 60)", "'-'"]
    rows = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS doc_id, {t} AS text, 'en' AS lang, 's' AS source, CAST(4 AS BIGINT) AS n_chars" for i, t in enumerate(texts))
    against_sql(spark, tmp_path, rows, "slugs", "first_per_slug")


def test_lines_of_no_order_and_of_odd_amounts(spark, tmp_path):
    """Lines without an order or a number, parts of units, and nothing, null and negative amounts."""
    con = duckdb.connect()
    lines = """SELECT CASE WHEN i % 55 = 0 THEN NULL ELSE i // 12 END AS l_orderkey, CAST(CASE WHEN i % 5 = 0 THEN NULL ELSE i % 12 END AS INTEGER) AS l_linenumber,
        CASE i % 7 WHEN 0 THEN 2.5 WHEN 1 THEN 3.5 WHEN 2 THEN 0.4 WHEN 3 THEN NULL WHEN 4 THEN -3 WHEN 5 THEN 10.7 ELSE 40 END::DOUBLE AS l_quantity,
        CASE i % 13 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN -7.5 ELSE 100 * (i % 7 + 1) + i / 100.0 END::DOUBLE AS l_extendedprice FROM range(600) t(i)"""
    con.sql(f"COPY ({lines}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    same(core.QUERIES["greedy_by_group"](spark, str(tmp_path)), con.sql(core.ORACLES["greedy_by_group"]))


def test_a_cycle_is_measured_when_asked(spark, tmp_path, monkeypatch):
    """The edges of a cycle do not wait for probes over all of them."""
    from assocgraph.operators import temporal

    asked = []
    monkeypatch.setattr(temporal, "health", lambda edges, state, config, seed, own=temporal.health: asked.append(seed) or own(edges, state, config, seed))
    texts = "SELECT range AS doc_id, 'same words ' || range % 3 AS text, 'en' AS lang, 's' AS source, 4 AS n_chars FROM range(30)"
    against_sql(spark, tmp_path, texts, "maintain")
    assert asked == []
    done = more.one_cycle(spark, str(tmp_path))
    assert 0 < done.health <= 1 and done.health == done.health and asked == [None]


def test_a_batch_in_groups_keeps_its_picks_only(spark, tmp_path, monkeypatch):
    """Groups of queries give the rows of all at once, and no activation is left on disk."""
    import os

    from assocgraph.operators import retrieve
    from assocgraph.session import Tables

    con, left = duckdb.connect(), []
    con.sql(f"COPY (SELECT range AS doc_id, 'common w' || range % 7 || ' x' || range % 5 || repeat(' more', (range % 4)::int) AS text, 'en' AS lang, 's' AS source, 4 AS n_chars FROM range(60)) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    con.sql(f"COPY (SELECT range AS item_id, CASE WHEN range = 3 THEN 'unknown' ELSE 'common w' || range END AS text FROM range(9)) TO '{tmp_path}/benchmark.parquet' (FORMAT parquet)")
    ask = lambda: sorted(map(tuple, core.QUERIES["retrieve_batch"](spark, str(tmp_path)).collect()))
    want = ask()
    own = Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, name, df, **o: [own(self, name, df, **o), left.append((name, self.paths[name], df.count() if name == "ignited" else 0))][0])
    monkeypatch.setattr(retrieve, "MANY_ROWS", 150)
    assert ask() == want and len(want) > 8
    lit = [n for name, _, n in left if name == "ignited"]
    assert len(lit) == 4 and max(lit) < sum(lit)
    assert not [name for name, path, _ in left if os.path.exists(path) and name.startswith(("ignited", "now", "base", "fixed", "found", "change", "asked", "norms", "nodes"))]
