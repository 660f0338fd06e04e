"""A catalog of versioned tables: every save is a new folder, and the newest complete pointer file names the one that counts."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, END = "CURRENT", "end"


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def _fs(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())


def pointers(spark: SparkSession, root: str) -> list[tuple[int, list[str]]]:
    """Number and lines (version, tables) of the complete pointers, in order. A pointer is complete if it ends with its last line."""
    found = _fs(spark, root).globStatus(_path(spark, root, f"{POINTER}-*")) or []
    out = []
    for x in found:
        lines = [r.value for r in spark.read.text(x.getPath().toString()).collect()]
        if lines and lines[-1] == END:
            out.append((int(x.getPath().getName().split("-")[1]), lines[:-1]))
    return sorted(out)


def save(spark: SparkSession, root: str, tables: dict[str, DataFrame], partition_by: dict[str, str] | None = None, keep: dict[str, str] | None = None) -> str:
    """Write all tables to a new version and add a pointer to it. Nothing is moved or replaced: readers see the old version
    until the new pointer is whole, and a save that fails leaves none.

    keep: tables that the last version has already, unchanged, as {name: folder}; the pointer names their folders.
    """
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        writer = df.write
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(f"{root.rstrip('/')}/{version}/{name}")
    before = pointers(spark, root)
    number = before[-1][0] + 1 if before else 0
    out = _fs(spark, root).create(_path(spark, root, f"{POINTER}-{number:09d}-{uuid.uuid4().hex}"), False)
    lines = [f"{name}={version}/{name}" for name in tables] + [f"{name}={folder}" for name, folder in (keep or {}).items()]
    out.write(bytearray("\n".join([*sorted(lines), END]).encode()))
    out.close()
    return version


def folders(spark: SparkSession, root: str) -> dict[str, str] | None:
    """The folder of each table of the current version, below the root; None without a pointer or if one is missing."""
    found = pointers(spark, root)
    if not found:
        return None
    named = dict(line.split("=", 1) for line in found[-1][1])
    return named if all(_fs(spark, root).exists(_path(spark, root, f)) for f in named.values()) else None


def load(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """The tables of the current version; None without a pointer or if a table is missing."""
    named = folders(spark, root)
    return None if named is None else {n: spark.read.parquet(f"{root.rstrip('/')}/{f}") for n, f in named.items()}


def consistent(tables: dict[str, DataFrame]) -> bool:
    """As many pages as nodes, every edge between known nodes, costs above 0."""
    nodes, edges = tables["nodes"], tables["edges"]
    known = nodes.select("node")
    stray = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).join(known, "node", "left_anti")
    return tables["pages"].count() == nodes.count() and not stray.head(1) and not nodes.filter("cost <= 0").head(1)


def meta_text(pages: DataFrame) -> DataFrame:
    """page_id, meta: the sidecar text of each page."""
    links = F.when(F.size("links_to") == 0, F.lit("  (none)")).otherwise(F.array_join(F.transform("links_to", lambda x: F.concat(F.lit("  - "), x)), "\n"))
    return pages.select("page_id", F.concat(F.lit("title: "), "title", F.lit("\ntokens: "), F.col("token_cost").cast("string"), F.lit("\ncategory: "), F.col("category").cast("string"), F.lit("\nlinks:\n"), links, F.lit("\n")).alias("meta"))


def page_text(title: str, content: str) -> str:
    return f"# {title}\n\n{content}\n"


def fingerprint(df: DataFrame) -> str:
    """A digest of the files that a table is read from: paths, sizes and times of change."""
    files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    row = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)")).alias("h")).first()
    return f"{row.n}-{row.h}"


def stage(root: str, name: str, inputs: list[DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage, made once for the files that its inputs are read from and reused while those stay the same."""
    spark = inputs[0].sparkSession
    key = hashlib.sha256("/".join(fingerprint(x) for x in inputs).encode()).hexdigest()[:32]
    path = f"{root.rstrip('/')}/{name}-{key}"
    if not _fs(spark, root).exists(_path(spark, path, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
