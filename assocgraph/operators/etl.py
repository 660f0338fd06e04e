"""Bulk transforms: projections, citation aggregation, ranking, section composition and page markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import salted_join, stored

#: Order and heading of each opinion type (fixed values); others come last as `Opinion`.
TYPES = {
    "010combined": (0, "Opinion"),
    "015unamimous": (0, "Opinion"),
    "020lead": (0, "Opinion"),
    "025plurality": (1, "Plurality Opinion"),
    "030concurrence": (2, "Concurrence"),
    "035concurrenceinpart": (2, "Concurrence in Part"),
    "040dissent": (3, "Dissent"),
    "050addendum": (4, "Addendum"),
    "060remittitur": (5, "Remittitur"),
    "070rehearing": (6, "On Rehearing"),
    "080onthemerits": (7, "On the Merits"),
    "090onmotiontostrike": (8, "On Motion to Strike"),
    "100trialcourt": (9, "Trial Court Opinion"),
}


def looked_up(kind: Column, at: int, default) -> Column:
    out = F.lit(default)
    for name, values in TYPES.items():
        out = F.when(kind == name, values[at]).otherwise(out)
    return out


def type_order(kind: Column) -> Column:
    return looked_up(kind, 0, 99)


def type_heading(kind: Column) -> Column:
    return looked_up(kind, 1, "Opinion")


def project(opinions: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """opinion, cluster of rows with both, restricted to wanted(cluster)."""
    rows = opinions.select(F.expr("try_cast(id AS BIGINT)").alias("opinion"), F.expr("try_cast(cluster_id AS BIGINT)").alias("cluster")).dropna()
    return rows if wanted is None else rows.join(wanted, "cluster", "left_semi").select("opinion", "cluster")


def aggregate_citations(citations: DataFrame, citing_map: DataFrame, cited_map: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """src, dst, depth: citations(citing, cited, depth) carried to clusters by the maps (opinion, cluster) and summed.

    Ends without a cluster, citations inside a cluster and clusters that are not wanted are dropped before the sum.
    """
    rows = citations.join(citing_map.select(F.col("opinion").alias("citing"), F.col("cluster").alias("src")), "citing").join(cited_map.select(F.col("opinion").alias("cited"), F.col("cluster").alias("dst")), "cited").filter("src <> dst")
    if wanted is not None:
        for end in ("src", "dst"):
            rows = rows.join(wanted.select(F.col("cluster").alias(end)), end, "left_semi")
    return rows.groupBy("src", "dst").agg(F.sum("depth").alias("depth"))


def top_citations(edges: DataFrame, k: int = 200) -> DataFrame:
    """The k deepest citations of each source, ties by target, with their rank."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("depth"), "dst"))
    return edges.withColumn("rank", rank).filter(F.col("rank") <= k)


def sections(opinions: DataFrame) -> DataFrame:
    """cluster, body: the opinions (cluster, id, type, md) of a cluster with headings, by type order and id."""
    rows = opinions.select("cluster", F.struct(type_order(F.col("type")).alias("at"), "id", F.concat(F.lit("## "), type_heading(F.col("type")), F.lit("\n\n"), "md").alias("text")).alias("s"))
    return rows.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]), "\n\n").alias("body"))


def header(cluster: Column, name: Column, short: Column, filed: Column, status: Column, count: Column) -> Column:
    """The head of a page: the name (the short one, or `Case <cluster>`, if there is none) and the known facts in italics."""
    chosen = F.trim(F.coalesce(F.nullif(name, F.lit("")), short, F.lit("")))
    title = F.when(chosen == "", F.concat(F.lit("Case "), cluster.cast("string"))).otherwise(chosen)
    some = F.when(count > 0, F.concat(count.cast("string"), F.lit(" incoming citations")))
    facts = F.concat_ws(", ", F.concat(F.lit("filed "), F.nullif(filed, F.lit(""))), F.nullif(F.lower(status), F.lit("")), some)
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.when(facts == "", "").otherwise(F.concat(F.lit("*"), facts, F.lit("*\n\n"))))


def footer(edges: DataFrame, names: DataFrame, k: int = 200) -> DataFrame:
    """src, md: the section of a page's citations with their number."""
    sizes = top_citations(edges, k).groupBy("src").agg(F.count("*").alias("n"))
    listed = sizes.join(citation_list(edges, names, k), "src", "left")
    lines = F.coalesce(F.concat("md", F.lit("\n")), F.lit(""))
    return listed.select("src", F.concat(F.lit("## Cites ("), F.col("n").cast("string"), F.lit(")\n\n"), lines, F.lit("\n")).alias("md"))


def case_pages(meta: DataFrame, opinions: DataFrame, edges: DataFrame, names: DataFrame, k: int = 200) -> DataFrame:
    """cluster, body: header, opinions and citations of each cluster of meta(cluster, case_name, case_name_short, date_filed,
    precedential_status, citation_count)."""
    head = meta.select("cluster", header(*[F.col(c) for c in ("cluster", "case_name", "case_name_short", "date_filed", "precedential_status", "citation_count")]).alias("head"))
    middle = sections(opinions).select("cluster", F.concat("body", F.lit("\n\n")).alias("middle"))
    tail = footer(edges, names, k).select(F.col("src").alias("cluster"), F.col("md").alias("tail"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return head.join(middle, "cluster", "left").join(tail, "cluster", "left").select("cluster", F.concat("head", empty("middle"), empty("tail")).alias("body"))


def citation_list(edges: DataFrame, names: DataFrame, k: int = 200) -> DataFrame:
    """src, md: the list of a page's citations, deepest first, with a mark for repeated ones. names: cluster, page_id, name."""
    rows = top_citations(edges, k).join(names.select(F.col("cluster").alias("dst"), "page_id", "name"), "dst")
    line = F.concat(F.lit("- [["), "page_id", F.lit("|"), F.translate("name", "|[]", " ()"), F.lit("]]"), F.when(F.col("depth") > 1, F.concat(F.lit(" ×"), F.col("depth").cast("string"))).otherwise(F.lit("")))
    return rows.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n").alias("md"))


def first_of_each(records: DataFrame, key: str, order: str) -> DataFrame:
    """The first record of each key; redirects are left out."""
    real = records.filter(~F.lower(F.ltrim("text")).startswith("#redirect [["))
    return real.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_r = 1").drop("_r")


def wikitext_pages(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """node, md: wikitext of pages(node, text) as markdown; links among the pages titles(title) become [[slug|text]].

    Links of dropped namespaces go, those to other pages leave their text. Links become rows, meet the known slugs in one
    join, however popular a slug is, and go back between the pieces of text that they came from. The prepared text is stored,
    so that it is made once, although the links and the pieces are both taken from it.
    """
    ready = stored("ready", pages.select("node", tx.wikitext_prepared(F.col("text")).alias("text")))
    found = ready.select("node", F.posexplode(F.regexp_extract_all("text", F.lit(tx.WIKILINK), F.lit(1))).alias("at", "inner"))
    inner = F.trim("inner")
    cut = found.select("node", "at", F.trim(F.substring_index(inner, "|", 1)).alias("target"), F.trim(F.regexp_replace(inner, r"\A[^|]*\|", "")).alias("display"))
    bare = F.when(F.contains("target", F.lit("#")), F.trim(F.substring_index("target", "#", 1))).otherwise(F.col("target"))
    named = cut.select("node", "at", "display", bare.alias("bare"), tx.dropped_namespace(F.col("target")).alias("gone"), tx.link_slug(F.col("target")).alias("slug"))
    known = titles.select(tx.normalized_link(F.col("title")).alias("slug")).distinct().withColumn("known", F.lit(True))
    side = named.groupBy("slug").agg(F.count("*").alias("n")).join(known, "slug", "left")
    plain = (F.col("display") == "") | (F.lower("display") == F.lower("bare"))
    link = F.when(plain, F.concat(F.lit("[["), "slug", F.lit("]]"))).otherwise(F.concat(F.lit("[["), "slug", F.lit("|"), "display", F.lit("]]")))
    text = F.when(F.col("gone"), "").when((F.col("bare") != "") & F.col("known"), link).otherwise(F.col("display"))
    back = salted_join(named, side, "slug", "n", "node").groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("t")))), lambda a: a["t"]).alias("texts"))
    pieces = F.transform(F.split("text", tx.WIKILINK, -1), lambda p, i: F.concat(p, F.coalesce(F.get(F.col("texts"), i), F.lit(""))))
    return ready.join(back, "node", "left").select("node", tx.wikitext_finished(F.array_join(pieces, "")).alias("md"))


def landmarks(pages: DataFrame, n: int, least_bytes: int = 2048) -> DataFrame:
    """The n pages with the most citations among those with a body of some length."""
    return pages.filter(F.octet_length("body") >= least_bytes).orderBy(F.desc("citations"), "node").limit(n)


#: An anchor with its address and content.
ANCHOR = r"(?is)<a\b[^>]*?href=[\x22']([^\x22']*)[\x22'][^>]*>(.*?)</a>"


def linked_markup(pages: DataFrame, targets: DataFrame, key: str = r"([^/?#]+)/?$") -> DataFrame:
    """node, md: html(node, html) as markdown, with [[page_id|text]] for anchors whose address has a target.

    targets: key, page_id. `key` takes an anchor's key from its address. Anchors become rows, meet their targets in one join
    and go back between the pieces of text they came from; other anchors leave their text.
    """
    pattern = F.lit(ANCHOR)
    found = pages.select("node", F.posexplode(F.regexp_extract_all("html", pattern, F.lit(0))).alias("at", "whole"))
    parts = found.select("node", "at", F.regexp_extract(F.regexp_extract("whole", ANCHOR, 1), key, 1).alias("key"), F.trim(F.regexp_replace(F.regexp_extract("whole", ANCHOR, 2), "<[^>]*>", "")).alias("label"))
    # a label's own bars and brackets would end the link; without a label the page stands for itself
    safe = F.coalesce(F.nullif(F.translate("label", "|[]", " ()"), F.lit("")), F.col("page_id"))
    named = parts.join(targets, "key", "left").select("node", F.struct("at", F.when(F.col("page_id").isNotNull(), F.concat(F.lit("[["), "page_id", F.lit("|"), safe, F.lit("]]"))).otherwise(F.col("label")).alias("text")).alias("a"))
    back = named.groupBy("node").agg(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["text"]).alias("texts"))
    pieces = F.transform(F.split("html", ANCHOR, -1), lambda p, i: F.concat(p, F.coalesce(F.get(F.col("texts"), i), F.lit(""))))
    return pages.join(back, "node", "left").select("node", tx.html_to_markdown(F.array_join(pieces, "")).alias("md"))
