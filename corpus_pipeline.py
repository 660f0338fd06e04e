"""The corpus pipeline: toxicity, exact dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of documents:
toxicity and the two dedups drop rows, substring dedup shortens texts (and sets n_chars). Packing returns, for each document
that is left, its length in words, bucket, boundary, batch and slot.

Defined results, in every stage: a null text counts as empty; null values in other columns,
and columns whose names the operators use inside, are handed on as they are; an empty table gives an empty table; of rows
that tie, the smallest doc_id stays, and a null doc_id only if there is no other. Each stage states its own below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assocgraph.llm import exact_dedup, near_dedup, packing, substring_dedup, toxicity
from assocgraph.llm.common import Tables, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.5 or more go. Rows that repeat share their fate; an empty text scores as one without any
    margin; without labelled texts of both kinds all rows get the share of toxic ones as their score."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, white space apart, the longest original stays, then the smallest doc_id. Empty and null
    texts are one group; of rows that repeat an id and a text, one stays."""
    return exact_dedup.unique_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a class of near copies the row with the smallest doc_id stays; texts without a word are one class. Rows that repeat
    the id and text that stay, stay each (the stage before leaves none)."""
    return near_dedup.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that start in a document with a smaller doc_id go and what is left is joined by single spaces; a text
    that loses nothing stays as it is. Null texts become empty, a document of which nothing is left stays as an empty one,
    and rows that repeat an id count as one document."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = substring_dedup.strip(docs, others, rejoin=False)
    values = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return left.select(*[values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null or empty text has length 0 and a place in the first bucket; rows that repeat have a place each."""
    return packing.pack_texts(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Fitted dictionaries, sketches and the dynamic program are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark, "snappy")
    for _, stage in STAGES[:-1]:
        docs = tables.write("stage", stage(spark, docs, sf_dir))  # the table of the stage before goes once this one is complete
    return STAGES[-1][1](spark, docs, sf_dir)
