"""Ranked lexical search over document-sharded postings with precomputed integer impacts.

A term is a run of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case. A document of n terms has the
length factor m = 25 + (75 n N) div L, where N documents hold a term and L terms are in all of them. A term that occurs tf times in it has the
impact (10^9 tf) div (1000 tf + 8 m), and the weight floor(1000 ln((2 N + 2) / (2 df + 1))). A document's score for an item
is the sum of weight times impact over the item's terms, repeats included, all in 64-bit integers.

1. `build` counts N and L in a first pass. A second one cuts the documents of each task into shards of about `SHARD_TERMS`
   terms and writes a row for each: the ids in ascending order, the vocabulary, and postings in compressed sparse rows
   (`df` rows each, document numbers and impacts). Nothing is shuffled.
2. `search` takes the items in blocks of about `BLOCK_TERMS` different terms, looks up the document frequencies of a block's terms
   in the vocabularies (the postings stay unread), and hands weights and items to every task. A task adds up one term after
   the other in a dense accumulator per shard and item, picks with argpartition, and keeps the best k of all its shards.
3. The tasks' best are merged in two steps, so that no task gets those of all tasks for one item if there are many.

Defined results: a null or empty text, or one without a term, is no document and no item; rows that repeat an id are
documents of their own, each with a rank; a null id comes after all others where scores tie; items that repeat id and text are one item, those
that share an id only are items each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Tables, id_and_text, in_arrow, pieces

#: Terms of a shard, different terms of a block of items, and best documents of an item.
SHARD_TERMS, BLOCK_TERMS, BEST = 1_000_000, 200_000, 10

#: What is no part of a term becomes a space, and A-Z lower case. Bytes beyond ASCII are parts of terms.
PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(128)).lower() + bytes(range(128, 256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(PLAIN).split()


@dataclass
class Index:
    """shards: ids, vocabulary, df (arrays), docs, impacts (little-endian 32-bit integers); N and L of all of them."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def totals(docs: DataFrame) -> tuple[int, int]:
    """N and L. docs: doc_id, text."""

    def run(batches):
        for batch in pieces(batches):
            sizes = [len(terms_of(t)) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(1 for n in sizes if n)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["n", "l"])

    got = in_arrow(docs.select("text"), run, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return got.n or 0, got.l or 0


def shard(ids: pa.Array, texts: list[list[bytes]], n_docs: int, n_terms: int, names: list[str]) -> pa.RecordBatch:
    """One row of the index, for the documents of the given ids and terms."""
    order = pc.sort_indices(ids).to_numpy(zero_copy_only=False)  # nulls last
    ids, texts = ids.take(pa.array(order)), [texts[i] for i in order.tolist()]
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.fromiter((number[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    cells, tf = np.unique(flat * len(texts) + np.repeat(np.arange(len(texts)), sizes), return_counts=True)
    at = cells % len(texts)
    m = 25 + (75 * sizes * n_docs) // n_terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[at])
    df = np.bincount(cells // len(texts), minlength=len(number))
    one = np.array([0, 0], np.int32)
    values = [
        pa.ListArray.from_arrays(pa.array(one + [0, len(ids)], pa.int32()), ids),
        pa.ListArray.from_arrays(pa.array(one + [0, len(number)], pa.int32()), pa.array(list(number), pa.binary()).cast(pa.string())),
        pa.array([df.astype(np.int32)], pa.list_(pa.int32())),
        pa.array([at.astype("<i4").tobytes()], pa.binary()),
        pa.array([impact.astype("<i4").tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(values, names)


def build(docs: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index over all documents, as a table of `tables`."""
    own = id_and_text(docs, id_col, text_col)
    n_docs, n_terms = totals(own)
    kind = own.schema["doc_id"].dataType.simpleString()
    names = ["ids", "vocabulary", "df", "docs", "impacts"]

    def run(batches):
        ids, texts, held = [], [], 0
        for batch in pieces(batches):
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                if words := terms_of(text):
                    ids.append(batch.column(0).slice(i, 1))
                    texts.append(words)
                    held += len(words)
                if held >= SHARD_TERMS:
                    yield shard(pa.concat_arrays(ids), texts, n_docs, n_terms, names)
                    ids, texts, held = [], [], 0
        if texts:
            yield shard(pa.concat_arrays(ids), texts, n_docs, n_terms, names)

    rows = in_arrow(own, run, f"ids array<{kind}>, vocabulary array<string>, df array<int>, docs binary, impacts binary")
    # a row is some MB: readers take row groups whole, so those hold few rows
    return Index(tables.write("postings", rows, **{"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}), n_docs, n_terms)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, key (of the item's text), term, times."""
    text = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    own = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias(text_col)).distinct()
    return own.select("item_id", F.sha2(F.col(text_col), 256).alias("key"), F.explode(words).alias("term")).groupBy("item_id", "key", "term").agg(F.count("*").alias("times"))


def frequencies(index: Index, terms: DataFrame) -> DataFrame:
    """term, df of the given different terms, from the vocabularies alone."""
    side = F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms  # a checked size
    seen = index.shards.select(F.explode(F.arrays_zip("vocabulary", "df")).alias("v")).select(F.col("v.vocabulary").alias("term"), F.col("v.df").alias("df"))
    return seen.join(side, "term").groupBy("term").agg(F.sum("df").alias("df"))


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores above 0, of equal ones the first."""
    if len(scores) > k:
        least = scores[np.argpartition(scores, len(scores) - k)[-k:]].min()
        above = np.flatnonzero(scores > max(least, 0))
        ties = np.flatnonzero(scores == least)[: k - len(above)] if least > 0 else above[:0]
        return np.concatenate([above, ties])
    return np.flatnonzero(scores > 0)


def order_of(hit: tuple) -> tuple:
    """Sorts hits (score, id): highest score, then ascending id, nulls last."""
    score, i = hit
    return (-score, i is None, 0 if i is None else i)


def shard_hits(ids: pa.Array, vocabulary: pa.Array, df: np.ndarray, docs: np.ndarray, impacts: np.ndarray, asked: pa.Array, items: list, k: int) -> Iterator[tuple[int, int, int]]:
    """(item, score, id) of each item's best in a shard. items: numbers into asked, weights."""
    starts = np.concatenate([[0], np.cumsum(df, dtype=np.int64)])
    place = pc.fill_null(pc.index_in(asked, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for item, (numbers, weights) in enumerate(items):
        here = place[numbers]
        if not (here >= 0).any():
            continue
        total = np.zeros(len(ids), np.int64)
        for t, w in zip(here.tolist(), weights.tolist()):
            if t < 0:
                continue
            if t not in known:
                lo, hi = starts[t], starts[t + 1]
                known[t] = docs[lo:hi], impacts[lo:hi].astype(np.int64)
            where, what = known[t]
            total[where] += w * what
        top = best_of(total, k)
        for score, i in zip(total[top].tolist(), ids.take(pa.array(top)).to_pylist()):
            yield item, score, i


def task_hits(shards: DataFrame, asked: list[str], items: list, k: int) -> DataFrame:
    """item (number), doc_id, score: each task's best of its shards."""
    kind = shards.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        words = pa.array(asked, pa.string())
        best: dict[int, list] = {}
        arrow = None
        for batch in batches:
            for r in range(batch.num_rows):
                ids, vocabulary, df, docs, impacts = (batch.column(c)[r] for c in range(5))
                arrow = ids.values.type
                new: dict[int, list] = {}
                for item, score, i in shard_hits(ids.values, vocabulary.values, df.values.to_numpy(), np.frombuffer(docs.as_buffer(), "<i4"), np.frombuffer(impacts.as_buffer(), "<i4"), words, items, k):
                    new.setdefault(item, []).append((score, i))
                for item, hits in new.items():
                    best[item] = sorted(best.get(item, []) + hits, key=order_of)[:k]
        rows = [(item, i, score) for item, hits in best.items() for score, i in hits]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], arrow), pa.array([x[2] for x in rows], pa.int64())], ["item", "doc_id", "score"])

    return in_arrow(shards.select("ids", "vocabulary", "df", "docs", "impacts"), run, f"item int, doc_id {kind}, score long")


def ranked(hits: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k hits of each group, with rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = BEST, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = items.sparkSession
    tables = Tables(spark)
    terms = tables.write("terms", item_terms(items, id_col, text_col))
    blocks = max(1, -(-terms.select("term").distinct().count() // BLOCK_TERMS))
    found = []
    for b in range(blocks):
        block = terms.filter(F.pmod(F.xxhash64("item_id", "key"), F.lit(blocks)) == b) if blocks > 1 else terms
        df = frequencies(index, block.select("term").distinct())
        weight = F.floor(1000 * F.log((2.0 * F.lit(index.n_docs) + 2) / (2 * F.col("df") + 1)))
        rows = block.join(df, "term").select("item_id", "key", "term", (F.col("times") * weight).alias("weight")).orderBy("item_id", "key", "term").collect()  # a block's terms
        number = {t: i for i, t in enumerate(dict.fromkeys(r.term for r in rows))}
        grouped: dict[tuple, list] = {}
        for r in rows:
            grouped.setdefault((r.item_id, r.key), []).append((number[r.term], r.weight))
        own = [(np.array([n for n, _ in g]), np.array([w for _, w in g], np.int64)) for g in grouped.values()]
        hits = task_hits(index.shards, list(number), own, k)
        named = spark.createDataFrame([(i, *key) for i, key in enumerate(grouped)], f"item int, item_id {terms.schema['item_id'].dataType.simpleString()}, key string")
        parts = math.isqrt(index.n_terms // SHARD_TERMS)
        if parts > 1:
            hits = ranked(hits.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(parts))), ["item", "part"], k)
        best = ranked(hits.select("item", "doc_id", "score"), ["item"], k)
        found.append(best.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))  # the items of a block
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
