"""Changes of pages and their links as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import graph


SEE_ALSO = "## See Also"


def with_backlink(body: Column, target: Column) -> Column:
    """The body with [[target]] in its first `## See Also` section, before the line break that the next heading follows, or at
    the end of a new section; unchanged if the link is there already."""
    link = F.concat(F.lit("[["), target, F.lit("]]"))
    at = F.instr(body, SEE_ALSO) + len(SEE_ALSO)
    rest = F.substring(body, at, F.length(body))
    following = F.instr(rest, "\n## ")
    end = F.when(following > 0, at + following - 1).otherwise(F.length(body) + 1)
    grown = F.concat(F.substring(body, F.lit(1), end - 1), F.lit("\n- "), link, F.substring(body, end, F.length(body)))
    return F.when(F.contains(body, link), body).when(F.contains(body, F.lit(SEE_ALSO)), grown).otherwise(F.concat(body, F.lit(f"\n\n{SEE_ALSO}\n\n- "), link, F.lit("\n")))


def add_backlinks(pages: DataFrame, links: DataFrame) -> DataFrame:
    """pages(page_id, body, ...) with the links(page_id, target) written into their bodies, in order of target."""
    per_page = links.groupBy("page_id").agg(F.array_sort(F.collect_set("target")).alias("_targets"))
    joined = pages.join(per_page, "page_id", "left")
    body = F.aggregate(F.coalesce("_targets", F.array().cast("array<string>")), F.col("body"), lambda b, t: with_backlink(b, t))
    return joined.withColumn("body", body).select(*pages.columns)


def valid_id(page_id: Column) -> Column:
    """Ids are relative and stay inside the root."""
    return (page_id != "") & ~page_id.startswith("/") & ~F.array_contains(F.split(page_id, "/"), "..")


def upsert(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """Pages with the rows of changes in place of those of the same page_id."""
    return pages.join(changes.select("page_id"), "page_id", "left_anti").unionByName(changes)


def relink(edges: DataFrame, pages: DataFrame, changed: DataFrame) -> DataFrame:
    """src, dst, raw_w after changed(node, body) got new links: edges that stay keep their weight, new ones have 1.

    pages: node, page_id. Links to unknown pages are dropped.
    """
    targets = pages.select(F.col("node").alias("dst"), F.col("page_id").alias("target"))
    new = changed.select(F.col("node").alias("src"), F.explode(tx.links(F.col("body"))).alias("target")).join(targets, "target").filter("src <> dst").select("src", "dst").distinct()
    touched = edges.join(changed.select(F.col("node").alias("src")), "src", "left_semi")
    rest = edges.join(changed.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst", "raw_w")
    kept = new.join(touched.select("src", "dst", "raw_w"), ["src", "dst"], "left").select("src", "dst", F.coalesce("raw_w", F.lit(1.0)).alias("raw_w"))
    return rest.unionByName(kept)


def sitemap(pages: DataFrame) -> DataFrame:
    """page_id, priority."""
    share = F.least(F.lit(0.3), F.size("links_to") * 0.01)
    return pages.select("page_id", F.round(F.least(F.lit(0.9), 0.5 + share), 2).alias("priority"))


def out_links(pages: DataFrame, k: int) -> DataFrame:
    return graph.hubs(pages.select("node", F.size("links_to").cast("long").alias("n")), k)
