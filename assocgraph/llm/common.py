"""Small helpers shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Tables, durable, table  # noqa: F401  the operators and queries take them from here

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile("[^\x20\x09-\x0d]+")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text, null texts as empty ones; whatever else the table holds cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that Python holds the texts of one slice and not of a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Rows and bytes of the batches that go to Python and back, unless the session has its own: both sides hold some of them
#: outside of the heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow with batches of moderate size."""
    conf = df.sparkSession.conf
    for key, (default, own) in BATCH.items():
        if conf.get(key, default) == default:
            conf.set(key, own)
    return df.mapInArrow(run, schema)


def crc_mod(id_col: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the contracts."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string").cast("binary")) % n


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not use yet."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, for as long as the job's folder lasts."""
    return Tables(df.sparkSession, "snappy").write("table", df)


#: Keys that may count as heavy, and rows from which one can: heavy keys are broadcast, so no task gets all of a key's rows.
HEAVY_KEYS, HEAVY_ROWS = 10_000, 1000


def join_back(rows: DataFrame, side: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """rows joined with side, which has one row for each key and in `n` its number of rows, of `total`.

    Keys with more than their share of rows, no more than `HEAVY_KEYS` by that, join by a broadcast and stay where they are.
    """
    limit = max(HEAVY_ROWS, total // HEAVY_KEYS)
    keys = [key] if isinstance(key, str) else key
    heavy = F.broadcast(side.filter(F.col(n) > limit))
    light = rows.join(heavy.select(*keys), keys, "left_anti").join(side.filter(F.col(n) <= limit), keys)
    return light.unionByName(rows.join(heavy, keys))


def salted_join(rows: DataFrame, side: DataFrame, keys: list[str], n: str, total: int, by: list[str]) -> DataFrame:
    """rows joined with side as in `join_back`, in one pass over rows: for those that are costly to make and not stored.

    A heavy key's rows are dealt by a hash of the columns `by` to as many salts as they need, and side has a row for each.
    """
    limit = max(HEAVY_ROWS, total // HEAVY_KEYS)
    parts = F.ceil(F.col(n) / limit)
    heavy = F.broadcast(side.filter(F.col(n) > limit).select(*keys, parts.alias("_parts")))
    dealt = rows.join(heavy, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*by), "_parts"), F.lit(0))).drop("_parts")
    return dealt.join(side.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))), [*keys, "_salt"]).drop("_salt")


#: Rows of a small table that one task handles.
TASK_ROWS = 200_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than so many rows need: many small files cost more than the work on them."""
    return df.coalesce(max(8, -(-rows // TASK_ROWS)))


#: Rows of ids and digests that may be broadcast, after a count; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, lost: DataFrame, same: Column) -> DataFrame:
    """docs without the rows that have a partner in lost."""
    small = lost.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(lost) if small else lost, same, "left_anti")
