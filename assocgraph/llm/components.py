"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, join_back, sized


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def to_least(rows: DataFrame, total: int, key: str = "u", value: str = "v", least: int = 1) -> DataFrame:
    """rows (key, value) with m, the least value of their key, for keys of at least `least` rows."""
    low = rows.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return join_back(rows, low, key, "_n", total).drop("_n")


def _unfinished(edges: DataFrame) -> bool:
    """Whether any node has two smaller neighbours, or one that is not the smallest of its own."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return bool(ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1 AND down > 0").head(1))


def components(edges: DataFrame, tables: Tables | None = None, name: str = "components") -> DataFrame:
    """node, root: the smallest node of each node's component, for every node that is in an edge (u, v).

    Each step is two aggregations and joins over the edges, whose table replaces that of the step before. A node with very
    many neighbours is the key of a partial aggregation, or joined by a broadcast. Steps end when every component is a star.
    """
    tables = tables or Tables(edges.sparkSession)
    edges = tables.write(name, _pairs(edges))
    n = edges.count()
    while n and _unfinished(edges):
        # large star: the larger neighbours of a node go to the smallest of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = to_least(both, 2 * n).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v")
        large = tables.write(f"{name}-large", sized(sized(large, n).distinct(), n))
        # small star: a node's smaller neighbours, and the node itself, go to the smallest of them
        small = to_least(large, n)
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = tables.write(name, sized(sized(small, n).distinct(), n))
        n = edges.count()
    tables.drop(f"{name}-large")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
