"""Readers and writers of bulk exports. Schemas are explicit, bad rows are skipped, compressed files are read as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Tables
from . import records

META = "case_name STRING, case_name_short STRING, date_filed STRING, citation_count BIGINT, precedential_status STRING"


def csv(spark: SparkSession, path: str, columns: tuple[str, ...], multiline: bool = True, limit: int | None = None) -> DataFrame:
    """Columns by header name, as strings; quotes are escaped by a backslash, rows may be ragged, line breaks are kept.

    `limit` caps the rows that are scanned, before any filter. Large files are read by many tasks, also those with line
    breaks in values.
    """
    rows = (records.csv(spark, path) if multiline else spark.read.csv(path, header=True, inferSchema=False, **records.CSV)).select(*columns)
    return rows if limit is None else rows.limit(limit)


def whole(column: str) -> Column:
    return F.expr(f"try_cast({column} AS BIGINT)").alias(column)


def opinions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """id, cluster_id, type, html; rows without numbers in the first two are skipped."""
    rows = csv(spark, path, ("id", "cluster_id", "type", "html_with_citations"), limit=limit)
    return rows.select(whole("id"), whole("cluster_id"), "type", F.col("html_with_citations").alias("html")).dropna(subset=["id", "cluster_id"])


def citations(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """citing, cited, depth; rows that lack one are skipped. One row a line, so large files are split."""
    rows = csv(spark, path, ("citing_opinion_id", "cited_opinion_id", "depth"), multiline=False, limit=limit)
    digits = lambda c, n: F.expr(f"try_cast(regexp_extract({c}, '^\"?([0-9]+)', 1) AS BIGINT)").alias(n)
    return rows.select(digits("citing_opinion_id", "citing"), digits("cited_opinion_id", "cited"), digits("depth", "depth")).dropna()


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, depth of a file without header."""
    return spark.read.schema("src LONG, dst LONG, depth INT").csv(path, mode="DROPMALFORMED").dropna()


def id_set(spark: SparkSession, path: str) -> DataFrame:
    """cluster: one number a line, each once."""
    return spark.read.text(path).select(F.expr("try_cast(trim(value) AS BIGINT)").alias("cluster")).dropna().distinct()


def opinion_map(spark: SparkSession, path: str) -> DataFrame:
    """opinion, cluster of a file without header; of rows with one opinion the last one of the file counts."""
    rows = spark.read.schema("opinion LONG, cluster LONG").csv(path, mode="DROPMALFORMED").dropna()
    placed = rows.select("opinion", "cluster", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("at")).alias("at"))
    return placed.groupBy("opinion").agg(F.max_by("cluster", "at").alias("cluster"))


def cluster_meta(spark: SparkSession, path: str) -> DataFrame:
    """cluster and its facts from one JSON object per file, keyed by id; keys that are no numbers are skipped. A large file is
    read by many tasks."""
    rows = records.object_members(spark, path, f"STRUCT<{META.replace(' STRING', ': STRING').replace(' BIGINT', ': BIGINT')}>")
    return rows.select(F.expr("try_cast(key AS BIGINT)").alias("cluster"), "m.*").dropna(subset=["cluster"]).withColumn("citation_count", F.coalesce("citation_count", F.lit(0)))


def bodies(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """id, cid, type, html from JSON lines; bad lines are skipped."""
    rows = spark.read.schema("id LONG, cid LONG, type STRING, html STRING").json(path, mode="DROPMALFORMED").dropna(subset=["id"])
    return rows if wanted is None else rows.join(wanted.select(F.col("cluster").alias("cid")), "cid", "left_semi")


def wiki_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pageid LONG, title STRING, wikitext STRING, categories ARRAY<STRING>").json(path, mode="DROPMALFORMED").dropna(subset=["title"])


def dockets(spark: SparkSession, path: str, court: str) -> DataFrame:
    return csv(spark, path, ("id", "court_id")).filter(F.col("court_id") == court).select(whole("id")).dropna()


def clusters(spark: SparkSession, path: str, of: DataFrame) -> DataFrame:
    """Clusters of the dockets `of` (id)."""
    rows = csv(spark, path, ("id", "docket_id", "case_name", "case_name_short", "date_filed", "citation_count", "precedential_status", "slug"))
    own = rows.select(whole("id"), whole("docket_id"), "case_name", "case_name_short", "date_filed", F.coalesce(F.expr("try_cast(citation_count AS BIGINT)"), F.lit(0).cast("long")).alias("citation_count"), "precedential_status", "slug").dropna(subset=["id"])
    return own.join(of.select(F.col("id").alias("docket_id")), "docket_id", "left_semi")


def peek(rows: DataFrame, column: str, n: int = 5, least_bytes: int = 200, chars: int = 500) -> DataFrame:
    """The first rows with a body of some length, cut for looking at."""
    return rows.filter(F.octet_length(column) >= least_bytes).limit(n).withColumn(column, F.left(column, F.lit(chars)))


def write_bodies(opinions_read: DataFrame, wanted: DataFrame, folder: str) -> None:
    """The opinion map of all rows, and the bodies of the wanted clusters (cluster) that have one.

    The rows are parsed once, into a table that both outputs are written from.
    """
    tables = Tables(opinions_read.sparkSession)
    opinions_read = tables.write("opinions", opinions_read)
    opinions_read.select("id", "cluster_id").write.mode("overwrite").csv(f"{folder}/opinion_to_cluster")
    kept = opinions_read.join(wanted.select(F.col("cluster").alias("cluster_id")), "cluster_id", "left_semi").filter("html <> ''")
    kept.select("id", F.col("cluster_id").alias("cid"), "type", "html").write.mode("overwrite").json(f"{folder}/bodies", compression="gzip")
    tables.drop()


def write_edges(edges: DataFrame, folder: str) -> None:
    edges.select("src", "dst", "depth").write.mode("overwrite").csv(folder)


def write_markdown(pages: DataFrame, folder: str) -> None:
    """page_id, body as rows of JSON lines, partitioned by the first two characters of the id: no file for each page."""
    pages.withColumn("prefix", F.left("page_id", F.lit(2))).write.mode("overwrite").partitionBy("prefix").json(folder, compression="gzip")
