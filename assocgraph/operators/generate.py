"""Synthetic link graphs for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Tables


def star(spark: SparkSession, n: int) -> DataFrame:
    """0 to every other node."""
    return spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))


def chain(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def clique(spark: SparkSession, n: int) -> DataFrame:
    """Every ordered pair, numbered instead of joined."""
    return spark.range(n * n).select(F.floor(F.col("id") / n).cast("long").alias("src"), (F.col("id") % n).alias("dst")).filter("src <> dst")


def reverse_star(spark: SparkSession, n: int) -> DataFrame:
    """Every other node to 0."""
    return star(spark, n).select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def cycle(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")).filter("src <> dst")


def bipartite(spark: SparkSession, n: int, m: int) -> DataFrame:
    """Each of n nodes to each of m others, numbered after them."""
    return spark.range(n * m).select(F.floor(F.col("id") / m).cast("long").alias("src"), (F.col("id") % m + n).alias("dst"))


def barbell(spark: SparkSession, n: int) -> DataFrame:
    """Two cliques of n nodes with an edge each way between their first ones."""
    one = clique(spark, n)
    other = one.select((F.col("src") + n).alias("src"), (F.col("dst") + n).alias("dst"))
    return one.unionByName(other).unionByName(spark.createDataFrame([(0, n), (n, 0)], "src long, dst long"))


def preferential(spark: SparkSession, n: int, m: int, seed: int = 1) -> DataFrame:
    """Each new node links to m earlier ones, likelier to those with many links; the first m + 1 nodes are a clique.

    A node draws 4 m times and keeps the first m different nodes (filled up from the clique). A draw copies an end of a random
    earlier draw or clique edge: its source, which is known, or with even odds its target, which may be copied in turn. Such
    references are followed twice as far by each join, so their number is about the logarithm of the longest chain.
    """
    first, draws = (m + 1) * m, 4 * m  # edges of the clique, draws of a node
    tables = Tables(spark)
    e, draw = F.col("id"), lambda k: F.xxhash64("id", F.lit(seed), F.lit(k))
    node = lambda i: F.when(i < first, F.floor(i / m)).otherwise(F.floor((i - first) / draws) + m + 1).cast("long")
    in_clique = F.when(e % m >= F.floor(e / m), e % m + 1).otherwise(e % m)
    before = F.lit(first) + F.floor((e - first) / draws) * draws  # what there was before the node
    picked = F.pmod(draw(0), before).cast("long")
    copied = (e >= first) & (draw(1) % 2 != 0)
    rows = spark.range(first + max(0, n - m - 1) * draws).select("id", node(e).alias("src"), F.when(e < first, in_clique).when(~copied, node(picked)).alias("dst"), F.when(copied, picked).alias("ref"))
    rows = tables.write("draws", rows)
    while rows.filter("ref IS NOT NULL").head(1):
        known = rows.select(F.col("id").alias("ref"), F.col("dst").alias("its"), F.col("ref").alias("next"))
        step = rows.join(known, "ref", "left").select("id", "src", F.coalesce("dst", "its").alias("dst"), F.when(F.col("dst").isNull() & F.col("its").isNull(), F.col("next")).alias("ref"))
        rows = tables.write("draws", step)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("id", "dst"))), lambda x: x["dst"])
    kept = rows.groupBy("src").agg(in_order.alias("to")).select("src", F.explode(F.slice(F.array_union("to", F.sequence(F.lit(0).cast("long"), F.lit(m).cast("long"))), 1, m)).alias("dst"))
    return kept.filter("src <> dst")


def build(spark: SparkSession, spec: str) -> DataFrame:
    """Edges of `star-N`, `chain-N`, `clique-N`, `cycle-N`, `reverse-N`, `barbell-N`, `bipartite-N-M` or `ba-N-M`."""
    kind, *numbers = spec.split("-")
    makers = {"star": (star, 1), "chain": (chain, 1), "clique": (clique, 1), "cycle": (cycle, 1), "reverse": (reverse_star, 1), "barbell": (barbell, 1), "bipartite": (bipartite, 2), "ba": (preferential, 2)}
    if kind not in makers or len(numbers) != makers[kind][1] or not all(x.isdigit() for x in numbers):
        raise ValueError(f"unknown graph: {spec}")
    return makers[kind][0](spark, *map(int, numbers))


def pages(edges: DataFrame, n: int) -> DataFrame:
    """path, body of pages `page-<number>` whose links are the edges."""
    name = lambda c: F.format_string("page-%05d", c)
    linked = edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("to"))
    rows = edges.sparkSession.range(n).withColumnRenamed("id", "src").join(linked, "src", "left")
    links = F.array_join(F.transform(F.coalesce("to", F.array().cast("array<bigint>")), lambda t: F.concat(F.lit("[["), name(t), F.lit("]]"))), " ")
    return rows.select(F.col("src").alias("node"), F.concat(name(F.col("src")), F.lit(".md")).alias("path"), F.concat(F.lit("# "), name(F.col("src")), F.lit("\n\n"), links, F.lit("\n")).alias("body"))
