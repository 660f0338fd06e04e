"""Session defaults and the ways to cut a lineage that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build(name: str = "assocgraph", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; a cluster's own settings are kept."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own on a local master where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-")


#: Spark's setting that shuffle files go when a job's rows are written, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Jobs of many steps keep the shuffle files of one step only; a setting that the session has is kept."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """The rows of df from a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    with shuffles_removed(df.sparkSession):
        return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, stem: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


class Tables:
    """Tables in the shared folder that cut lineages: read by column, and deleted when they are no longer needed.

    Without a codec named they are not compressed: hashes and weights hardly shrink, and the compressors' buffers are outside
    of the heap.
    """

    def __init__(self, spark: SparkSession, codec: str = "none"):
        self.spark, self.codec, self.paths = spark, codec, {}

    def write(self, name: str, df: DataFrame, **options) -> DataFrame:
        """df as a table; one of the same name that was there before is deleted once the new one is complete."""
        path, old = new_folder(self.spark, name), self.paths.get(name)
        with shuffles_removed(self.spark):
            df.write.options(compression=self.codec, **options).parquet(path)
        self.paths[name] = path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names or list(self.paths):
            if path := self.paths.pop(name, None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(name: str, df: DataFrame) -> DataFrame:
    """The rows of df from a table by column, compressed: numbers and terms that repeat take a few bytes, while a checkpoint
    has every row as it is in memory."""
    return Tables(df.sparkSession, "snappy").write(name, df)


#: Rows of one key that a task may get; beyond, they are dealt to several. At 10^12 rows there are 10^6 such keys at most.
KEY_ROWS = 1_000_000


def salted_join(rows: DataFrame, side: DataFrame, key: str, n: str, by: str) -> DataFrame:
    """rows joined with side, which has one row for each key and in `n` its number of rows.

    The rows of a key that has more than `KEY_ROWS` are dealt by a hash of the column `by`, and side has a row for each part.
    """
    parts = F.ceil(F.col(n) / KEY_ROWS)
    heavy = F.broadcast(side.filter(F.col(n) > KEY_ROWS).select(key, parts.alias("_parts")))
    dealt = rows.join(heavy, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), "_parts"), F.lit(0))).drop("_parts")
    return dealt.join(side.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))), [key, "_salt"]).drop("_salt")


#: Keys that are broadcast because they have the most rows.
COMMON_KEYS = 100_000


def common_join(rows: DataFrame, side: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with side, which is stored and has one row for each key and in `n` its number of rows.

    Keys with more than a `COMMON_KEYS`-th of all rows, of which there are no more than that, meet their rows where these are;
    only rows of the other keys, each of which has few, are exchanged.
    """
    total = side.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first().n
    common = F.col(n) > total / COMMON_KEYS
    here = rows.join(F.broadcast(side.filter(common)), key)
    rest = rows.join(F.broadcast(side.filter(common).select(key)), key, "left_anti").join(side.filter(~common), key)
    return here.unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
