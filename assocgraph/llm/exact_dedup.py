"""Exact deduplication in three combining steps, each comparing the full content.

1. Each task merges the equal texts among its own rows (the map side of the first aggregation).
2. Rows of one digest are merged in salted groups, so that a text with very many copies is spread over tasks.
3. The winners of the salts are merged per digest: at most `salts` rows for a text.

The normalised text is a grouping key of every step, so texts are joined only when they are equal, not when digests are.
Rows get their winner back over two independent digests and the length, which the steps before carry along: no text is
merged there, and it would have to travel once more. Texts with very many rows are salted there, too.

Defined results: a null text counts as empty; empty texts are one group; of equal texts the longest original stays, then
the smallest doc_id (a null doc_id only if there is no other); rows that repeat an id and text are one group's members and
all carry the same keep_id; an empty table gives an empty table; other columns are ignored. `unique_rows` keeps one of the
rows that repeat the id and text that stay, the first by their lang, source and n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, id_and_text, salted_join, without, written


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """doc_id, original length, normalised text, digests and salt of each row."""
    bare = F.translate("text", SPACES, "")
    own = id_and_text(docs, id_col, text_col).select("doc_id", F.char_length("text").cast("long").alias("size"), bare.alias("bare"))
    return own.select("doc_id", "size", "bare", F.sha2(F.col("bare").cast("binary"), 256).alias("sha"), F.xxhash64("bare").alias("xx"), F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts)).alias("salt"))


def winners(rows: DataFrame) -> DataFrame:
    """One row for each different text: the row that stays and the number of rows.

    The order (longest, then smallest id) is one number, size * 2^65 + (2^63 - id), or + 0 without an id. It fits 38 digits
    and lets both aggregations run in hash tables with fixed-width buffers.
    """
    whole = lambda n: F.expr(f"CAST({n} AS DECIMAL(20,0))")
    rank = F.col("size").cast("decimal(17,0)") * whole(2**65) + F.coalesce(whole(2**63) - F.col("doc_id").cast("decimal(19,0)"), whole(0))
    first = rows.groupBy("sha", "xx", "salt", "bare").agg(F.max(rank).alias("best"), F.count("*").alias("n"))
    final = first.groupBy("sha", "xx", "bare").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    order = F.col("best") % whole(2**65)
    keep = F.when(order > 0, (whole(2**63) - order).cast("long"))
    return final.select("sha", "xx", F.char_length("bare").alias("bare_size"), keep.alias("keep_id"), F.expr(f"best DIV CAST({2**65} AS DECIMAL(20,0))").alias("keep_size"), "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, size (code points of the original) of each row."""
    rows = prepared(docs, id_col, text_col, salts)
    best = written(winners(rows))  # digests and numbers: texts stop here, and are merged once for both sides of what follows
    slim = rows.select("doc_id", "size", "sha", "xx", F.char_length("bare").alias("bare_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size"))
    out = salted_join(slim, best, ["sha", "xx", "bare_size"], "group_size", docs.count(), ["doc_id", "size"])
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), "size")


def unique_rows(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The rows of docs, all columns, that stay; of rows that repeat an id and text one."""
    groups = written(exact_groups(docs, salts=salts))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    here = [F.sha2(F.translate(text, SPACES, "").cast("binary"), 256), F.char_length(text)]
    lost = groups.filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("size").alias("_size")).distinct()
    out = without(docs, lost, docs["doc_id"].eqNullSafe(lost["_id"]) & (here[0] == lost["_sha"]) & (here[1] == lost["_size"]))
    if groups.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).filter("n > 1").head(1):
        # copies of a row are merged before they are shuffled
        order = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c in ("lang", "source", "n_chars")], F.lit(0))
        first = out.groupBy(F.col("doc_id").alias("_id"), here[0].alias("_sha")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("_row"))
        out = first.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    return out
