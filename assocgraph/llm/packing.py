"""Packing into optimal length buckets.

The global histogram of lengths decides the bucket boundaries: dynamic programming finds those that minimise the padding
when every document is padded to its bucket's boundary. Inside each bucket documents are dealt into batches whose padded
size stays within a token budget.

Lengths are numbers of words here (a parameter gives any other length column). Each length has a cell of its own: d different
lengths are at least d * (d - 1) / 2 words in all, so the histogram grows with the square root of the corpus at most. Only ids and lengths are shuffled, never texts. Ranks inside a bucket
are counted in salted cells of about `CELL_ROWS` rows each and shifted by the counts of the cells before them, so a bucket
that holds most rows is not one task, and all batches but the last of each bucket are full.

Defined results: a null or empty text has length 0 and is in the first bucket; a document longer than the budget is a batch
of its own; rows that repeat are packed each; equal lengths always share a bucket, and inside it a hash of id and length
orders the rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, id_and_text

BUCKETS, BUDGET = 16, 16_384
CELL_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Words, that is runs of anything but the six white space characters."""
    return F.size(F.filter(F.split(text, "[\x20\x09-\x0d]+"), lambda w: w != "")).cast("long")


def boundaries(cells: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """The upper boundaries of at most `buckets` buckets with the least padding. cells: (length, documents)."""
    cells = sorted(cells)
    size = np.array([c[0] for c in cells], np.float64)
    n = np.concatenate([[0.0], np.cumsum([c[1] for c in cells])])
    mass = np.concatenate([[0.0], np.cumsum(size * np.diff(n))])
    m, k = len(cells), min(buckets, len(cells))
    if not m:
        return []
    # best[j]: least padding of the first j cells; the last bucket holds cells i .. j-1 and pads them to size[j-1]
    best = np.full(m + 1, np.inf)
    best[0] = 0
    cuts = []
    for _ in range(k):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        todo = [(1, m, 0, m - 1)]
        while todo:  # the best cut never moves left as j grows, so each half needs only its part of the cuts
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + size[j - 1] * (n[j] - n[i]) - (mass[j] - mass[i])
            at = int(cost.argmin())
            new[j], cut[j] = cost[at], i[at]
            todo += [(lo, j - 1, a, int(i[at])), (j + 1, hi, int(i[at]), b)]
        best = np.minimum(new, np.inf)
        best[0] = np.inf
        cuts.append((cut, new[m]))
    # exactly q buckets for each q; take the fewest with the least padding
    q = min(range(k), key=lambda x: (cuts[x][1], x))
    out, j = [], m
    for level in range(q, -1, -1):
        out.append(cells[j - 1][0])
        j = int(cuts[level][0][j])
    return sorted(out)


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """lengths: doc_id, n_tokens. Adds bucket, boundary (tokens that each row is padded to), batch and slot in the batch."""
    own = durable(lengths.select("doc_id", "n_tokens", F.xxhash64("doc_id", "n_tokens").alias("h")))
    cells = [(r.n_tokens, r.n) for r in own.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()]
    tops = boundaries(cells, buckets)
    rows = [0] * max(1, len(tops))
    for size, n in cells:
        rows[bisect_left(tops, size)] += n

    def by_bucket(values: list[int]) -> Column:
        out = F.lit(values[-1])
        for top, v in reversed(list(zip(tops[:-1], values))):
            out = F.when(F.col("n_tokens") <= top, F.lit(v)).otherwise(out)
        return out.cast("long")

    tops = tops or [0]
    placed = own.select(
        "doc_id", "n_tokens", "h",
        by_bucket(list(range(len(tops)))).cast("int").alias("bucket"),
        by_bucket(tops).alias("boundary"),
        F.pmod(F.col("h"), by_bucket([max(1, -(-n // CELL_ROWS)) for n in rows])).alias("salt"),
        by_bucket([max(1, budget // max(1, t)) for t in tops]).alias("capacity"),
    )
    # one row per cell of about CELL_ROWS rows
    per_cell = placed.groupBy("bucket", "salt").agg(F.count("*").alias("n"))
    before = per_cell.select("bucket", "salt", (F.sum("n").over(Window.partitionBy("bucket").orderBy("salt")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("bucket", "salt").orderBy("h", "doc_id", "n_tokens")
    ranked = placed.withColumn("rn", F.row_number().over(inside)).join(before, ["bucket", "salt"])
    rank = F.col("before") + F.col("rn") - 1
    return ranked.select("doc_id", "n_tokens", "bucket", "boundary", F.floor(rank / F.col("capacity")).alias("batch"), F.pmod(rank, F.col("capacity")).alias("slot"))


def pack_texts(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    own = id_and_text(docs, id_col, text_col)
    return pack(own.select("doc_id", word_count(F.col("text")).alias("n_tokens")), buckets, budget)
