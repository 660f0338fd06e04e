"""Weighted directed graphs as two tables: edges(src, dst, raw_w, w) and nodes(node, cost)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Tables, salted_join

#: The largest 32-bit float: rows whose inverse sum exceeds it count as dead.
LARGEST = 3.4028234663852886e38


def from_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """src, dst, raw_w: loops and weights that are not positive are dropped, duplicates summed, ends restricted to nodes."""
    own = edges.select("src", "dst", F.col("raw_w").cast("double").alias("raw_w")).filter("src <> dst AND raw_w > 0")
    if nodes is not None:
        for end in ("src", "dst"):
            own = own.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return own.groupBy("src", "dst").agg(F.sum("raw_w").alias("raw_w"))


def from_dense(rows: DataFrame) -> DataFrame:
    """Edges of a dense matrix: rows(src, weights ARRAY<DOUBLE>); positions are the targets."""
    flat = rows.select("src", F.posexplode("weights").alias("dst", "raw_w"))
    return from_edges(flat.withColumn("dst", F.col("dst").cast("long")))


def from_csr(rows: DataFrame) -> DataFrame:
    """Edges of a compressed sparse matrix: rows(row_ptr, col_idx, vals), one row for a matrix or a slice of its rows.

    row_ptr counts from the start of the slice's arrays; `first` (0 without the column) numbers the slice's first row. Arrays
    that do not fit each other, pointers that fall and columns below 0 are refused with an error.
    """
    own = rows if "first" in rows.columns else rows.withColumn("first", F.lit(0))
    size = F.size("col_idx")
    falls = F.exists(F.zip_with(F.slice("row_ptr", F.lit(1), F.size("row_ptr") - 1), F.slice("row_ptr", F.lit(2), F.size("row_ptr") - 1), lambda x, y: x > y), lambda x: x)
    good = (F.size("vals") == size) & (F.size("row_ptr") > 0) & (F.get("row_ptr", F.lit(0)) == 0) & (F.element_at("row_ptr", -1) == size) & ~falls & ~F.exists("col_idx", lambda c: c < 0)
    checked = own.withColumn("row_ptr", F.when(good, F.col("row_ptr")).otherwise(F.raise_error(F.lit("not a sparse matrix: pointers, columns and values do not fit")).cast("array<bigint>")))
    cells = checked.select("first", "col_idx", "vals", F.posexplode(F.transform("row_ptr", lambda p, i: F.struct(p.alias("lo"), F.get("row_ptr", i + 1).alias("hi")))).alias("at", "span")).filter("span.hi IS NOT NULL")
    flat = cells.select((F.col("first") + F.col("at")).cast("long").alias("src"), F.explode(F.arrays_zip(F.expr("slice(col_idx, cast(span.lo + 1 as int), cast(span.hi - span.lo as int))").alias("dst"), F.expr("slice(vals, cast(span.lo + 1 as int), cast(span.hi - span.lo as int))").alias("raw_w"))).alias("c"))
    return from_edges(flat.select("src", F.col("c.dst").cast("long").alias("dst"), F.col("c.raw_w").alias("raw_w")))


def neighbors_out(edges: DataFrame, node: int) -> DataFrame:
    """node, raw_w of what a node links to, in order of node; edges of weight 0 are listed, too."""
    return edges.filter(F.col("src") == node).select(F.col("dst").alias("node"), "raw_w").orderBy("node")


def neighbors_in(edges: DataFrame, node: int) -> DataFrame:
    """node, raw_w of what links to a node."""
    return edges.filter(F.col("dst") == node).select(F.col("src").alias("node"), "raw_w").orderBy("node")


def from_links(pages: DataFrame) -> DataFrame:
    """Edges of weight 1 from pages(node, page_id, links_to); links to unknown pages and to oneself are dropped."""
    out = pages.select(F.col("node").alias("src"), F.explode("links_to").alias("target"))
    targets = pages.select(F.col("node").alias("dst"), F.col("page_id").alias("target"))
    return from_edges(out.join(targets, "target").select("src", "dst", F.lit(1.0).alias("raw_w")))


def normalize(edges: DataFrame) -> DataFrame:
    """Adds w, the share of the source's raw weight; 0 in rows without weight or whose inverse sum overflows."""
    own = edges.select("src", "dst", "raw_w")
    sums = own.groupBy("src").agg(F.sum("raw_w").alias("total"), F.count("*").alias("n"))
    total = F.col("total")
    alive = (total > 0) & (F.lit(1.0) / F.nullif(total, F.lit(0.0)) <= LARGEST)
    return salted_join(own, sums, "src", "n", "dst").select("src", "dst", "raw_w", F.when(alive, F.col("raw_w") / total).otherwise(0.0).alias("w"))


def not_stochastic(edges: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """src, total of the rows that sum neither to 1 nor to 0."""
    return edges.groupBy("src").agg(F.sum("w").alias("total")).filter((F.abs(F.col("total") - 1) > tolerance) & (F.abs("total") > tolerance))


def set_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """src, dst, raw_w after upserts: changes(src, dst, raw_w, seq); the last one counts, 0 removes, loops are ignored."""
    last = changes.filter("src <> dst").groupBy("src", "dst").agg(F.max_by("raw_w", "seq").alias("new_w"))
    both = edges.select("src", "dst", "raw_w").join(last, ["src", "dst"], "full")
    return both.select("src", "dst", F.coalesce("new_w", "raw_w").alias("raw_w")).filter("raw_w > 0")


def scale_rows(edges: DataFrame, factors: DataFrame) -> DataFrame:
    """raw_w times the factor of its source: factors(src, factor)."""
    return edges.join(factors, "src", "left").select("src", "dst", (F.col("raw_w") * F.coalesce("factor", F.lit(1.0))).alias("raw_w"))


def weight(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst, raw_w, w of the given pairs, 0 where there is no edge."""
    return pairs.join(edges, ["src", "dst"], "left").select("src", "dst", F.coalesce("raw_w", F.lit(0.0)).alias("raw_w"), F.coalesce("w", F.lit(0.0)).alias("w"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n_out, n_in."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counted = ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return nodes.select("node").join(counted, "node", "left").select("node", F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"), F.coalesce("n_in", F.lit(0)).cast("long").alias("n_in"))


def stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """n_nodes, n_edges, density."""
    n = nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))
    possible = F.col("n_nodes").cast("double") * (F.col("n_nodes") - 1)
    return n.select("n_nodes", "n_edges", (F.col("n_edges") / F.when(F.col("n_nodes") <= 1, 1.0).otherwise(possible)).alias("density"))


def hubs(sizes: DataFrame, k: int) -> DataFrame:
    """The k nodes with the largest n: at the cut larger node numbers win, in the output smaller ones come first."""
    return sizes.orderBy(F.desc("n"), F.desc("node")).limit(k).orderBy(F.desc("n"), "node")


def hops(edges: DataFrame, start: int, directed: bool = True, most: int | None = None, goal: int | None = None) -> DataFrame:
    """node, hop reached from a node by breadth-first search, a join with the frontier at each step."""
    spark = edges.sparkSession
    step = edges.select("src", "dst")
    if not directed:
        step = step.unionByName(step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    tables = Tables(spark)
    # each hop is a table of its own: written once, and read by the hops after it to leave out what is known
    found, hop = [tables.write("hop-0", spark.createDataFrame([(start, 0)], "node long, hop int"))], 0
    while most is None or hop < most:
        new = step.join(found[-1].select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        # one way, any earlier hop may be met again, both ways only the last two
        known = found if directed else found[-2:]
        new = new.join(reduce(DataFrame.unionByName, known).select("node"), "node", "left_anti")
        hop += 1
        new = tables.write(f"hop-{hop}", new.select("node", F.lit(hop).alias("hop")))
        if not new.head(1):
            tables.drop(f"hop-{hop}")
            break
        found.append(new)
        if goal is not None and new.filter(F.col("node") == goal).head(1):
            break
    return reduce(DataFrame.unionByName, found)


def shortest_path(edges: DataFrame, start: int, goal: int) -> int | None:
    """Number of hops, 0 if the ends are equal, None if there is no path."""
    found = hops(edges, start, goal=goal).filter(F.col("node") == goal).head()
    return None if found is None else int(found.hop)


#: Settings of a recursion over rows: without a limit of their number, as it grows with the pairs.
RECURSION = {"spark.sql.cteRecursionRowLimit": "-1"}


def paths(edges: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """start, goal, hops, path of pairs(start, goal) with a path of at most `most` hops: the shortest, of equal ones the least.

    One recursive query for all pairs. A path never comes to a node twice and ends at its goal, and `most` bounds the depth, so
    this is for short searches from many nodes; `hops` searches a whole graph from one.
    """
    spark = edges.sparkSession
    names = {"edges_": edges.select("src", "dst"), "pairs_": pairs.select("start", "goal").distinct()}
    kept = {k: spark.conf.get(k, None) for k in RECURSION}
    try:
        for k, v in RECURSION.items():
            spark.conf.set(k, v)
        walk = f"""
            WITH RECURSIVE walk(start, goal, node, hops, path) MAX RECURSION LEVEL {most + 1} AS (
              SELECT start, goal, start, 0, array(start) FROM {{pairs_}}
              UNION ALL
              SELECT start, goal, dst, hops + 1, array_append(path, dst) FROM walk JOIN {{edges_}} ON src = node
              WHERE hops < {most} AND node <> goal AND NOT array_contains(path, dst)
            ) SELECT start, goal, hops, path FROM walk WHERE node = goal"""
        # the limits hold while the query runs, so it runs here
        found = Tables(spark).write("paths", spark.sql(walk, **names))
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    best = found.groupBy("start", "goal").agg(F.min(F.struct("hops", "path")).alias("best"))
    return best.select("start", "goal", "best.hops", "best.path")


def neighborhood(edges: DataFrame, center: int, most: int = 48) -> DataFrame:
    """node, hop, direction, score of the undirected neighborhood of two hops.

    With more than `most` nodes those stay that come first by (hop, score descending, node); the score of a node two hops
    away is its largest raw weight, either way, with a direct neighbor, and 0 for others.
    """
    reached = hops(edges, center, directed=False, most=2)
    out = edges.filter(F.col("src") == center).select(F.col("dst").alias("node"), F.lit(True).alias("is_out"))
    into = edges.filter(F.col("dst") == center).select(F.col("src").alias("node"), F.lit(True).alias("is_in"))
    first = reached.filter("hop = 1").select(F.col("node").alias("near"))
    both = edges.select("src", "dst", "raw_w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "raw_w"))
    score = both.join(first, F.col("dst") == F.col("near")).groupBy(F.col("src").alias("node")).agg(F.max("raw_w").alias("best"))
    whole = reached.join(out, "node", "left").join(into, "node", "left").join(score, "node", "left")
    direction: Column = F.when(F.col("hop") == 0, "center").when(F.col("is_out") & F.col("is_in"), "both").when(F.col("is_out"), "out").when(F.col("is_in"), "in").otherwise("indirect")
    named = whole.select("node", "hop", direction.alias("direction"), F.when(F.col("hop") == 2, F.coalesce("best", F.lit(0.0))).otherwise(0.0).alias("score"))
    return named.orderBy("hop", F.desc("score"), "node").limit(most)


def edges_among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, raw_w of the edges between the nodes (node) of a neighborhood."""
    own = edges.filter("raw_w > 0").select("src", "dst", "raw_w")
    for end in ("src", "dst"):
        own = own.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return own.select("src", "dst", "raw_w")
