"""Records that may hold their own separator, read from files that are split anywhere.

The text reader cuts a file at each separator and its tasks share a large file, so a task starts without knowing whether it
starts inside a quoted value (or, for one large object, how deep in it). So each piece becomes a function of the state before
it: what the state is afterwards if it was outside of quotes, and if it was inside. A first pass over these functions alone
gives one for each block of a file; composed in order they give the state at which every block starts. A second pass
joins the pieces of each record. What a block has of a record of its neighbours is a fragment, at most two for each block,
and only fragments are shuffled.

States are columns, so both passes stay with Spark's own reader: compressed files that can be split (bzip2) are split, and
any store that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of rows: a whole record; the end, the beginning or a part of the middle of one.
WHOLE, END, BEGINNING, MIDDLE = range(4)
CSV = {"quote": '"', "escape": "\\", "mode": "PERMISSIVE"}


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """value, path, start (of the block in its file), in the order of the file within each block."""
    return spark.read.text(path, lineSep=separator).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def csv_states(rows: DataFrame) -> DataFrame:
    """Adds quoted_out, quoted_in: whether a quoted value is open after the piece, if none was open before or if one was; and
    depth_out, depth_in, 0 here.

    A quote opens a value only where a field begins; inside, the next quote that no backslash precedes closes it.
    """
    # escaped quotes and backslashes close nothing and begin no field
    plain = F.regexp_replace("value", r'\\["\\]', "e")

    def left_open(text: Column) -> Column:
        return F.regexp_replace(text, '(^|,)"[^"]*"', "$1q").rlike('(?:^|,)"')

    at = F.instr("plain", '"')
    inside = F.when(at == 0, True).otherwise(left_open(F.concat(F.lit("q"), F.expr("substring(plain, instr(plain, '\"') + 1)"))))
    own = rows.withColumn("plain", plain)
    return own.withColumns({"quoted_out": left_open(F.col("plain")), "quoted_in": inside, "depth_out": F.lit(0), "depth_in": F.lit(0)}).drop("plain")


def object_states(rows: DataFrame) -> DataFrame:
    """The same for pieces of an object that end before a closing brace: quotes open and close strings, and depth_* is how much
    deeper the next piece starts, the brace included unless it is in a string."""
    own = rows.withColumn("plain", F.regexp_replace("value", r"\\.", "e"))
    odd = (F.length(F.regexp_replace("plain", '[^"]', "")) % 2) == 1

    def deeper(text: Column, ends_inside: Column) -> Column:
        bare = F.regexp_replace(text, '"[^"]*(?:"|$)', "")
        return F.length(F.regexp_replace(bare, r"[^{]", "")) - F.when(ends_inside, 0).otherwise(1)

    from_inside = F.when(F.instr("plain", '"') == 0, "").otherwise(F.expr("substring(plain, instr(plain, '\"') + 1)"))
    return own.withColumns({"quoted_out": odd, "quoted_in": ~odd, "depth_out": deeper(F.col("plain"), odd), "depth_in": deeper(from_inside, ~odd)}).drop("plain")


def walk(out: np.ndarray, inside: np.ndarray, depth_out: np.ndarray, depth_in: np.ndarray, quoted: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a quoted value is open, and the depth, before each piece and after the last."""
    n = len(out)
    fixed = out == inside  # the state afterwards does not depend on the one before
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    swaps = np.cumsum(~fixed & out)  # pieces that turn the state round
    state = np.where(last >= 0, out[last], quoted) ^ ((swaps - np.where(last >= 0, swaps[last], 0)) % 2 == 1)
    before = np.concatenate([[quoted], state]).astype(bool)
    change = np.where(before[:-1], depth_in, depth_out)
    return before, depth + np.concatenate([[0], np.cumsum(change)])


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """path, start, rows: stretches of rows of one block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        path, start = batch.column("path"), batch.column("start").to_numpy()
        code = pc.dictionary_encode(path).indices.to_numpy()
        cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield path[lo].as_py(), int(start[lo]), batch.slice(lo, hi - lo)


def columns(rows: pa.RecordBatch) -> list[np.ndarray]:
    return [rows.column(c).to_numpy(zero_copy_only=False) for c in ("quoted_out", "quoted_in", "depth_out", "depth_in")]


def block_states(rows: DataFrame) -> DataFrame:
    """path, start, quoted, depth: the state at which each block begins. rows: path, start and the functions of pieces."""

    def run(batches):
        held: dict[tuple[str, int], list] = {}
        for path, start, part in by_block(batches):
            # what it does to a file's state if that is outside of quotes, and if it is inside
            own = held.setdefault((path, start), [(False, 0), (True, 0)])
            for k, (quoted, depth) in enumerate(own):
                before, deep = walk(*columns(part), quoted, depth)
                own[k] = (bool(before[-1]), int(deep[-1]))
        if held:
            flat = [(*key, *out, *inside) for key, (out, inside) in held.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "start", "quoted_out", "depth_out", "quoted_in", "depth_in"), x)) for x in flat])

    maps = rows.select("path", "start", "quoted_out", "quoted_in", "depth_out", "depth_in").mapInArrow(run, "path string, start long, quoted_out boolean, depth_out long, quoted_in boolean, depth_in long")
    # a row for each block, those of one file in one array
    listed = maps.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "quoted_out", "depth_out", "quoted_in", "depth_in"))).alias("blocks"))
    first = F.struct(F.lit(False).alias("quoted"), F.lit(0).cast("long").alias("depth"), F.expr("cast(array() as array<struct<start: bigint, quoted: boolean, depth: bigint>>)").alias("seen"))

    def compose(acc: Column, x: Column) -> Column:
        seen = F.concat(acc["seen"], F.array(F.struct(x["start"].alias("start"), acc["quoted"].alias("quoted"), acc["depth"].alias("depth"))))
        quoted = F.when(acc["quoted"], x["quoted_in"]).otherwise(x["quoted_out"])
        return F.struct(quoted.alias("quoted"), (acc["depth"] + F.when(acc["quoted"], x["depth_in"]).otherwise(x["depth_out"])).alias("depth"), seen.alias("seen"))

    return listed.select("path", F.explode(F.aggregate("blocks", first, compose)["seen"]).alias("b")).select("path", "b.start", "b.quoted", "b.depth")


def joined(rows: DataFrame, states: DataFrame, separator: str, top: int) -> DataFrame:
    """record, kind, path, start, first (record of the file). A record begins outside of quotes at a depth of at most `top`."""
    known = F.broadcast(states.select("path", "start", F.col("quoted").alias("at_quoted"), F.col("depth").alias("at_depth")))  # a row for each block: 10^6 for 100 TB
    placed = rows.join(known, ["path", "start"], "left").withColumn("at_quoted", F.coalesce("at_quoted", F.raise_error(F.lit("the files were split in another way")).cast("boolean")))
    names = ["record", "kind", "path", "start", "first"]

    def run(batches):
        now, held, quoted, depth, begun, first = None, [], False, 0, False, False

        def put(records: pa.Array, kind: int, is_first: bool) -> pa.RecordBatch:
            n = len(records)
            values = [records, pa.array([kind] * n, pa.int32()), pa.array([now[0]] * n), pa.array([now[1]] * n, pa.int64()), pa.array([is_first and i == 0 for i in range(n)])]
            return pa.RecordBatch.from_arrays(values, names)

        def text(parts: list[pa.Array]) -> pa.Array:
            whole = pa.concat_arrays(parts)
            return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), separator)

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                complete = not quoted and depth <= top
                yield put(text(held), (WHOLE if complete else BEGINNING) if begun else (END if complete else MIDDLE), first)

        for path, start, part in by_block(batches):
            if now != (path, start):
                yield from close()
                now, held, begun, first = (path, start), [], False, start == 0
                quoted, depth = part.column("at_quoted")[0].as_py(), part.column("at_depth")[0].as_py()
            before, deep = walk(*columns(part), quoted, depth)
            quoted, depth = bool(before[-1]), int(deep[-1])
            begins = np.flatnonzero(~before[:-1] & (deep[:-1] <= top))
            values = part.column("value")
            if not len(begins):
                held.append(values)
                continue
            if begins[0]:
                held.append(values.slice(0, begins[0]))
            if held:
                yield put(text(held), WHOLE if begun else END, first)
                first = False if begun else first
            if len(begins) > 1:
                inner = values.slice(begins[0], begins[-1] - begins[0])
                cuts = pa.array((begins - begins[0]).astype(np.int32))
                yield put(pc.binary_join(pa.ListArray.from_arrays(cuts, pa.concat_arrays([inner])), separator), WHOLE, first)
                first = False
            held, begun = [values.slice(begins[-1])], True
        if now is not None:
            yield from close()

    own = placed.select("value", "path", "start", "quoted_out", "quoted_in", "depth_out", "depth_in", "at_quoted", "at_depth")
    return own.mapInArrow(run, "record string, kind int, path string, start long, first boolean")


def stitched(rows: DataFrame, separator: str) -> DataFrame:
    """record, first: whole records, and those put together from the fragments of neighbouring blocks."""
    order = Window.partitionBy("path").orderBy("start", "kind")  # two rows for each block of a file
    numbered = rows.filter(F.col("kind") != WHOLE).withColumn("n", F.count(F.when(F.col("kind") == BEGINNING, 1)).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "kind", "record")))
    again = numbered.groupBy("path", "n").agg(F.array_join(F.transform(parts, lambda x: x["record"]), separator).alias("record"), F.max("first").alias("first"))
    return rows.filter(F.col("kind") == WHOLE).select("record", "first").unionByName(again.select("record", "first"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """record, first of files whose quoted values may hold line breaks; a carriage return before a record's end is dropped."""
    rows = csv_states(pieces(spark, path, "\n"))
    out = stitched(joined(rows, block_states(rows), "\n", 0), "\n")
    return out.select(F.regexp_replace("record", "\r$", "").alias("record"), "first").filter(F.trim("record") != "")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """The columns of the files' first records, as strings; every file has those columns in its first record."""
    names = spark.read.csv(path, header=True, multiLine=True, inferSchema=False, **CSV).columns
    schema = ", ".join(f"`{n}` string" for n in names)
    return csv_records(spark, path).filter(~F.col("first")).select(F.from_csv("record", schema, CSV).alias("r")).select("r.*")


def object_members(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key, m of files that hold one object each, whose members are objects of the type `value`."""
    rows = object_states(pieces(spark, path, "}"))
    out = stitched(joined(rows, block_states(rows), "}", 1), "}")
    # a record is `{ "key": {...` or `, "key": {...`, without the brace that ends it
    member = F.concat(F.lit("{"), F.regexp_replace("record", r"^[\s,{]+", ""), F.lit("}}"))
    return out.filter(F.instr("record", '"') > 0).select(F.explode(F.from_json(member, f"MAP<STRING, {value}>")).alias("key", "m"))
