"""Reading a folder of markdown pages, and the page table that everything else is built from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import durable


def scan(spark: SparkSession, root: str, hidden: str = ".state") -> DataFrame:
    """path (relative), body of every .md file under root; anything below a hidden folder is left out, and empty files."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("full"), F.col("value").alias("body"))
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    path = F.regexp_replace(F.url_decode(F.replace(F.regexp_replace("full", r"^[a-z]+:/*", "/"), F.lit("+"), F.lit("%2B"))), f"^{base}/", "")
    return files.select(path.alias("path"), "body").filter(~F.array_contains(F.split("path", "/"), hidden))


def read_meta(spark: SparkSession, root: str) -> DataFrame:
    """path, meta: the raw text of the sidecar files."""
    return spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.meta").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("meta"))


def categories(pages: DataFrame) -> DataFrame:
    """Adds category: a bit for each folder, by name, 0 in the root; folders past the 63rd share a bit."""
    own = pages.withColumn("folder", tx.folder(F.col("path")))
    # one row for each folder
    bits = own.select("folder").distinct().withColumn("k", F.row_number().over(Window.orderBy("folder")) - 1)
    bits = bits.select("folder", F.when(F.col("folder") == "", 0).otherwise(F.expr("shiftleft(1L, cast(least(k, 62) as int))")).cast("long").alias("category"))
    return own.join(bits, "folder").drop("folder")


def page_table(pages: DataFrame) -> DataFrame:
    """page_id, path, title, links_to, token_cost, category, body from path and body."""
    body, path = F.col("body"), F.col("path")
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^./]*$", "")
    rows = categories(pages)
    return rows.select(tx.page_id(path).alias("page_id"), "path", tx.title(body, stem).alias("title"), tx.links(body).alias("links_to"), tx.token_cost(body).alias("token_cost"), "category", "body")


def numbered(pages: DataFrame) -> DataFrame:
    """Adds node, the position in the order of page ids.

    Ids are ranked inside ranges and shifted by the sizes of the ranges before, so no task sorts all of them.
    """
    ranged = pages.select("page_id").repartitionByRange("page_id").select("page_id", F.spark_partition_id().alias("part"))
    ranged = durable(ranged)
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("page_id"))
    ids = ranged.withColumn("r", inside).join(F.broadcast(before), "part").select("page_id", (F.col("before") + F.col("r") - 1).cast("long").alias("node"))
    return pages.join(ids, "page_id")
