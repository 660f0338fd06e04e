"""Stored terms, ranges and recursive paths against models, and the plans that they are for."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from assocgraph.operators import graph, metrics, tfidf
from assocgraph.sources.terms import TermStore


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def lit_by(docs, query):
    """node, a by the index in memory. docs: rows of (doc_id, text)."""
    counts = tfidf.term_counts(docs)
    df, n = tfidf.document_frequency(counts), docs.count()
    index = tfidf.postings(counts, df, n)
    return {r.node: r.a for r in tfidf.ignite(index, tfidf.norms(index), tfidf.query_vector(df, query, n)).collect()}


def test_stored_terms_open_only_their_buckets(spark, tmp_path):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.randint(0, 9))) for i in range(40)}
    frame = lambda t: spark.createDataFrame(sorted(t.items()), "doc_id long, text string").cache()
    store = TermStore.create(tfidf.term_counts(frame(texts)), len(texts), str(tmp_path / "a"), 16)
    assert {r.node: r.a for r in store.ignite("alpha zeta unknown").collect()} == pytest.approx(lit_by(frame(texts), "alpha zeta unknown"))
    # plans say which buckets they take where a scan is by bucket; without it the same files are left out unsaid
    keys = {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        some, whole = plan(store.postings(["alpha", "zeta"])), plan(store.postings())
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert "SelectedBucketsCount: 2 out of 16" in some or "SelectedBucketsCount: 1 out of 16" in some
    assert "SortMergeJoin" in whole and "Exchange" not in whole and "Exchange" not in some  # postings and df meet where they are

    # a changed page, a new one and one that is gone
    before = {k: texts[k] for k in (3, 4)}
    texts |= {3: "alpha alpha fresh", 100: "fresh zeta"}
    texts[4] = ""
    now = {k: texts[k] for k in (3, 100)}
    store.add(tfidf.term_counts(frame(before)), tfidf.term_counts(frame(now)), spark.createDataFrame([(3,), (4,), (100,)], "node long"), len(texts))
    for own in (store, TermStore.open(spark, str(tmp_path / "a")), store.compact(str(tmp_path / "b"))):
        for query in ("alpha zeta", "fresh", "none"):
            assert {r.node: r.a for r in own.ignite(query).collect()} == pytest.approx(lit_by(frame(texts), query))
    assert TermStore.open(spark, str(tmp_path / "b")).parts == 1


def test_ranges_meet_points_by_bins(spark):
    rng = random.Random(3)
    chunks = [(k, a := rng.randint(-30, 300), a + rng.choice([0, 1, 2, 5, 64, 130, -3])) for k in range(60)]
    ranges = spark.createDataFrame(chunks, "chunk long, first long, end long")
    points = spark.range(-40, 300).select(F.col("id").alias("pos"))
    want = {(p, c) for p in range(-40, 300) for c, lo, hi in chunks if lo <= p < hi}
    for width in (1, 7, 64, 10_000):
        got = metrics.in_ranges(points, ranges, width)
        assert {(r.pos, r.chunk) for r in got.collect()} == want and got.count() == len(want)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    vectors = points.select("pos", F.array(F.sin("pos"), F.cos(F.col("pos") * 2.0), F.lit(0.5)).alias("v"))
    values = {r.pos: r.v for r in vectors.collect()}

    def mean(c, lo, hi):
        own = [values[p] for p in range(lo, hi) if p in values]
        cos = [sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 for a, b in itertools.combinations(own, 2)]
        return sum(cos) / len(cos) if cos else 1.0

    found = {r.chunk: (r.n, r.coherence) for r in metrics.range_coherence(vectors, ranges).collect()}
    assert set(found) == {c for c, _, _ in chunks}
    for c, lo, hi in chunks:
        assert found[c][0] == len([p for p in range(lo, hi) if p in values]) and found[c][1] == pytest.approx(mean(c, lo, hi))


def test_recursive_paths_are_the_shortest(spark):
    rng = random.Random(7)
    links = {(i, j) for i in range(14) for j in range(14) if i != j and rng.random() < 0.13}
    edges = spark.createDataFrame([(i, j, 1.0) for i, j in links], "src long, dst long, raw_w double")
    pairs = [(rng.randint(0, 13), rng.randint(0, 13)) for _ in range(30)] + [(2, 2), (0, 99), (2, 2)]
    got = {(r.start, r.goal): (r.hops, r.path) for r in graph.paths(edges, spark.createDataFrame(pairs, "start long, goal long"), 5).collect()}
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")

    def best(start, goal):
        front = [[start]]
        for _ in range(6):
            if ends := sorted(p for p in front if p[-1] == goal):
                return len(ends[0]) - 1, ends[0]
            front = [[*p, j] for p in front for i, j in links if i == p[-1] and j not in p]
        return None

    assert got == {p: b for p in set(pairs) if (b := best(*p))}
    assert limit != "-1"
    assert any(graph.shortest_path(edges, s, g) == h for (s, g), (h, _) in got.items())
