"""Near-duplicate classes by DartMinHash and banding.

A text is the weighted set of its word 5-grams (the weight is the number of occurrences), and two texts are near copies
when their weighted Jaccard similarity is 0.8 or more. A class is a connected component of near copies.

1. Sketches. Every element throws darts at (weight, rank): a Poisson process of unit density whose darts depend on the
   element alone. A dart below the element's weight counts, and each of `COORDINATES` coordinates keeps the dart of least
   rank, so two sets agree in a coordinate with the probability of their similarity. Only darts up to a rank are made,
   about k ln k + 2k of them however large the set; if a coordinate stays empty the rank is doubled.
2. Texts with equal sets become one node, so copies are never expanded.
3. Bands of four coordinates are grouped. A pair of similarity 0.8 shares none of the 24 bands in about 3 of 10^6 cases.
   Nodes that share bands, directly or through others, are a candidate group; a band's nodes are linked to its first one,
   so this takes as many links as there are band entries.
4. Inside a group of up to a block (`BLOCK` nodes, `BLOCK_BYTES` of sets) all pairs are compared over their whole sets,
   with an inverted index. A larger group is first dealt twice into random blocks, which brings together what is well
   connected at a cost in proportion to the group; then the nodes outside the group's largest component are compared with
   all others, block by block. So every pair of a group that could connect two components is compared, a set travels once
   for each block and not for each pair, and no task holds more than two blocks.

An element that occurs n times is n elements, numbered, in the comparison: their plain Jaccard similarity is the weighted one.
Tables between the steps are in the shared folder and deleted when the next one is complete. Bands, candidate groups, texts
and classes that hold very many rows are joined by broadcasts of their few keys, so their rows stay spread over the tasks.

Defined results: null counts as empty; texts without a word are one class; a text of fewer than five words is one element;
of a class the smallest doc_id (null only if all are) names it; rows that repeat are members each; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, id_and_text, in_arrow, join_back, pieces, without
from .components import components, to_least
from .shingles import mix, shingles

WORDS, SIMILARITY = 5, 0.8
COORDINATES, ROWS = 96, 4
#: Nodes of a block, and bytes of their sets (one set may be larger, and is then a block with few others).
BLOCK, BLOCK_BYTES = 256, 8 << 20
#: Ids of candidates that may be broadcast (8 bytes each); beyond, they are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def darts(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The signature of a weighted set that is not empty: for each of k coordinates 32 bits of its earliest dart."""
    theta = (k * math.log(k) + 2 * k) / float(weights.sum())
    while True:
        when, what = [], []
        start, length, cell = 0.0, 1.0, 0
        while True:  # cells of the weight axis: [0,1), [1,2), [2,4), [4,8) ...
            inside = weights > start
            if not inside.any():
                break
            for t, h in throws(elements[inside], weights[inside], cell, start, length, theta):
                when.append(t)
                what.append(h)
            start, length, cell = (1.0, 1.0, 1) if cell == 0 else (start * 2, start * 2, cell + 1)
        t, h = np.concatenate(when), np.concatenate(what)
        order = np.argsort(-t, kind="stable")
        sig, full = np.zeros(k, np.uint32), np.zeros(k, bool)
        at = (h[order] % np.uint64(k)).astype(np.int64)
        sig[at] = (h[order] >> np.uint64(32)).astype(np.uint32)
        full[at] = True
        if full.all():
            return sig
        theta *= 2


def throws(elements: np.ndarray, weights: np.ndarray, cell: int, start: float, length: float, theta: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ranks and hashes of the darts below rank theta in one cell of the weight axis that lie below the weights."""
    base = mix(elements + np.uint64(cell * 0xA24BAED4963EE407 % 2**64))
    now = np.zeros(len(base))
    first, width = 0, int(theta * length + 2 * math.sqrt(theta * length)) + 2
    while len(base):
        n = np.arange(first, first + width, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
        h = mix(base[:, None] + n[None, :])
        rank = now[:, None] + np.cumsum(-np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1) / length
        hit = rank < theta
        i, _ = np.nonzero(hit)
        own = mix(h[hit])
        below = start + (mix(own) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * length < weights[i]
        yield rank[hit][below], own[below]
        on = hit[:, -1]
        base, weights, now, first = base[on], weights[on], rank[on, -1], first + width


def set_key(elements: np.ndarray, weights: np.ndarray) -> bytes:
    return blake2b(elements.tobytes() + weights.astype("<u4").tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), key (digest of the weighted set), total weight, sig (null without words)."""

    def run(batches):
        for batch in pieces(batches):
            keys, totals, sigs = [], [], []
            for e, w in shingles(batch.column(1).to_pylist(), WORDS):
                keys.append(set_key(e, w))
                totals.append(int(w.sum()))
                sigs.append(darts(e, w).astype("<u4").tobytes() if len(e) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(totals, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "h", "key", "total", "sig"])

    own = id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    return in_arrow(own, run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, h long, key binary, total long, sig binary")


def numbered(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The elements of a weighted set as those of a plain one: the second and later occurrences count as others."""
    if not len(weights) or weights.max() == 1:
        return elements
    again = np.arange(weights.sum(), dtype=np.uint64) - np.repeat(np.cumsum(weights) - weights, weights).astype(np.uint64)
    each = np.repeat(elements, weights)
    return np.where(again == 0, each, mix(each ^ mix(again)))


def plain_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted rows (with key and head) and members: the elements of their sets as bytes."""

    def run(batches):
        for batch in pieces(batches):
            keys, members = [], []
            for e, w in shingles(batch.column(1).to_pylist(), WORDS):
                keys.append(set_key(e, w))
                members.append(numbered(e, w).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(members, pa.binary())], ["key", "members"])

    ids = wanted.select("head").distinct()
    if ids.count() <= BROADCAST_IDS:  # a checked size
        ids = F.broadcast(ids)
    some = docs.join(ids, docs["doc_id"].eqNullSafe(ids["head"]), "left_semi").select("doc_id", "text")
    sets = in_arrow(some, run, "key binary, members binary").groupBy("key").agg(F.any_value("members").alias("members"))
    return wanted.join(sets, "key").drop("key", "head")


def links_in_block(nodes: list[int], sets: list[bytes], asks: list[bool], roots: list[int]) -> list[tuple[int, int]]:
    """Links that connect what is similar among sets that are not empty: each asking set against all, by inverted index.

    Only links between different components count, those in `roots` to begin with, so there are fewer links than nodes.
    """
    n = len(nodes)
    totals = np.array([len(x) // 8 for x in sets])
    elements, owner = np.frombuffer(b"".join(sets), "<u8"), np.repeat(np.arange(n, dtype=np.int32), totals)
    order = np.argsort(elements, kind="stable")
    owner_at = owner[order]
    new = np.concatenate([[True], np.diff(elements[order]) != 0])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(elements)))
    which = np.empty(len(elements), np.int32)
    which[order] = np.cumsum(new) - 1
    ends = np.cumsum(totals)
    label = np.unique(np.array(roots), return_inverse=True)[1]
    found = []
    for i in range(n):
        if not asks[i] or (label == label[i]).all():
            continue
        own = which[ends[i] - totals[i] : ends[i]]
        own = own[size[own] > 1]
        count = size[own]
        at = np.repeat(first[own] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        both = np.bincount(owner_at[at], minlength=n)
        near = np.flatnonzero((both >= SIMILARITY * (totals + totals[i] - both)) & (label != label[i]))
        for j in near.tolist():
            if label[j] != label[i]:
                found.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
    return found


def similar(rows: DataFrame) -> DataFrame:
    """Links (u, v) inside the groups of rows. rows: grp (string), node, members, asks, root."""

    def run(batches):
        held: dict[str, list] = {k: [] for k in ("node", "members", "asks", "root")}
        at = None

        def report():
            found = links_in_block(held["node"], held["members"], held["asks"], held["root"]) if len(held["node"]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            new = {k: batch.column(k).to_pylist() for k in held}
            for i, grp in enumerate(batch.column("grp").to_pylist()):
                if grp != at and held["node"]:
                    yield report()
                    held = {k: [] for k in held}
                at = grp
                for k in held:
                    held[k].append(new[k][i])
        if held["node"]:
            yield report()

    return in_arrow(rows.select("grp", "node", "members", "asks", "root").repartition("grp").sortWithinPartitions("grp"), run, "u long, v long")


def candidate_groups(nodes: DataFrame, total: int, tables: Tables) -> DataFrame:
    """node, grp, blocks: the candidate group of every node that shares a band, and the number of blocks it needs."""
    bands = F.array(*[F.xxhash64(F.lit(b), F.expr(f"substring(sig, {4 * ROWS * b + 1}, {4 * ROWS})")) for b in range(COORDINATES // ROWS)])
    rows = nodes.filter("sig IS NOT NULL").select("node", F.explode(bands).alias("bucket"))
    links = to_least(rows, total * (COORDINATES // ROWS), "bucket", "node", 2).select(F.col("node").alias("u"), F.col("m").alias("v"))
    found = components(links, tables, "groups").join(nodes.select("node", "total"), "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("total") * 8 / BLOCK_BYTES))
    sizes = found.groupBy("root").agg(blocks.alias("blocks"), F.count("*").alias("_n"))
    return join_back(found, sizes, "root", "_n", total).select("node", F.col("root").alias("grp"), "blocks")


def link(docs: DataFrame, nodes: DataFrame, total: int, tables: Tables) -> DataFrame:
    """node, root for every node that has a link."""
    groups = tables.write("grouped", nodes.select("node", "key", "head").join(candidate_groups(nodes, total, tables), "node"))
    tables.drop("groups")
    sets = tables.write("sets", plain_sets(docs, groups))
    deal = lambda rows, seed: rows.select(F.concat_ws("/", "grp", F.pmod(F.xxhash64("node", F.lit(seed)), "blocks")).alias("grp"), "node", "members", F.lit(True).alias("asks"), F.col("node").alias("root"))
    edges = tables.write("links", similar(deal(sets, 1)))
    large = sets.filter("blocks > 1")
    if large.select("node").head(1):
        edges = tables.write("links", edges.unionByName(similar(deal(large, 2))))
        roots = components(edges, tables, "dealt")
        own = groups.filter("blocks > 1").select("node", "grp").join(roots, "node", "left").select("node", "grp", F.coalesce("root", "node").alias("root"))
        own = tables.write("placed", own)
        per_root = own.groupBy("grp", "root").agg(F.count("*").alias("n"))
        giant = per_root.groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("giant"), F.max("n").alias("inside"), F.sum("n").alias("n"))
        # few groups have more than one block
        giant = giant.filter("n > inside").join(groups.filter("blocks > 1").select("grp", "blocks").distinct(), "grp")
        giant = giant.select("grp", "giant", "n", F.ceil(F.col("blocks") * F.col("inside") / F.col("n")).alias("g"), F.ceil(F.col("blocks") * (1 - F.col("inside") / F.col("n"))).alias("s"))
        tasks = join_back(own, giant, "grp", "n", total).withColumn("outside", F.col("root") != F.col("giant")).select("node", "grp", "root", "outside", "g", "s")
        tasks = tables.write("tasks", tasks)
        if tasks.count() <= BROADCAST_IDS:  # a checked size: numbers only
            tasks = F.broadcast(tasks)
        rows = large.select("node", "members").join(tasks, "node")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("outside"), F.col("s")).otherwise(F.col("g"))))
        upto = lambda name: F.sequence(F.lit(0).cast("long"), F.col(name) - 1)
        # tasks: a block outside against itself, against each later block outside, and against each block of the component
        task = lambda kind, i, j: F.concat_ws("/", F.col("grp"), F.lit(kind), i, j)
        to = F.when(
            F.col("outside"),
            F.concat(
                F.transform(upto("s"), lambda j: F.struct(task("s", F.least("block", j), F.greatest("block", j)).alias("grp"), (F.col("block") <= j).alias("asks"))),
                F.transform(upto("g"), lambda j: F.struct(task("g", F.col("block"), j).alias("grp"), F.lit(True).alias("asks"))),
            ),
        ).otherwise(F.transform(upto("s"), lambda i: F.struct(task("g", i, F.col("block")).alias("grp"), F.lit(False).alias("asks"))))
        dealt = rows.select("node", "members", "root", F.explode(to).alias("to")).select("to.grp", "node", "members", "to.asks", "root")
        edges = tables.write("links", edges.unionByName(similar(dealt)))
    tables.drop("sets", "grouped", "placed", "tasks", "dealt")
    roots = components(edges, tables, "linked")
    tables.drop("links")
    return roots


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: Tables | None = None) -> DataFrame:
    """doc_id, h (hash of the text), class_id, class_size, kept: the class of each row, and whether it is the one that stays.

    The row with the smallest (doc_id, h) of a class stays. Whoever hands in `tables` may drop them after reading the rows.
    """
    tables = tables or Tables(docs.sparkSession)
    docs = id_and_text(docs, id_col, text_col)
    sketched = tables.write("sketched", sketches(docs))
    total = sketched.count()
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    grouped = sketched.groupBy("key").agg(F.min(first).alias("first"), F.any_value("total").alias("total"), F.any_value("sig").alias("sig"), F.count("*").alias("rows"))
    # numbered once and written, so that the numbers hold when a task is run again
    nodes = tables.write("nodes", grouped.select("*", F.col("first.doc_id").alias("head"), F.monotonically_increasing_id().alias("node")))
    placed = nodes.join(link(docs, nodes, total, tables), "node", "left").select("key", "first", "rows", F.coalesce("root", "node").alias("root"))
    whole = placed.groupBy("root").agg(F.min("first").alias("first"), F.sum("rows").alias("class_size"), F.count("*").alias("_n"))
    named = join_back(placed.select("key", "root", "rows"), whole, "root", "_n", total)
    named = named.select("key", F.col("first.doc_id").alias("class_id"), F.col("first.h").alias("first_h"), "class_size", "rows")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("first_h"))
    out = join_back(sketched.select("doc_id", "h", "key"), named, "key", "rows", total)
    return out.select("doc_id", "h", "class_id", "class_size", kept.alias("kept"))


def one_of_each(docs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """The rows of docs, all columns, that stay."""
    own = Tables(docs.sparkSession)
    lost = (tables or Tables(docs.sparkSession)).write("lost", classes(docs, tables=own).filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct())
    own.drop()
    here = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return without(docs, lost, docs["doc_id"].eqNullSafe(lost["_id"]) & (here == lost["_h"]))
