"""Access state kept by a stream: one micro-batch is one logical step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder


def advance(state: DataFrame | None, batch: DataFrame, step: int) -> DataFrame:
    """node, n, last_ts, last_step after the accesses (node, ts) of one more batch."""
    new = batch.groupBy("node").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).withColumn("last_step", F.lit(step).cast("long"))
    if state is None:
        return new
    return state.unionByName(new).groupBy("node").agg(F.sum("n").alias("n"), F.max("last_ts").alias("last_ts"), F.max("last_step").alias("last_step"))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The steps of the complete versions in a folder, in order."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/v=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(x.getPath().getParent().getName()[2:]) for x in found or [])


def follow(spark: SparkSession, accesses: DataFrame, folder: str, keep: int = 2) -> int:
    """Run the stream accesses(node, ts) to the end of what is there; versions of the state go to folder/v=<step>.

    A version is written from the last complete one before it, never in place, so a batch that is run again after a failure
    gives the same version; the last `keep` stay. Returns the last step there is, -1 without any: a source without rows, or
    without new ones since the run before, adds no version.
    """

    def step(batch: DataFrame, number: int) -> None:
        earlier = [v for v in versions(spark, folder) if v < number]
        before = spark.read.parquet(f"{folder}/v={earlier[-1]}") if earlier else None
        advance(before, batch, number).write.mode("overwrite").parquet(f"{folder}/v={number}")
        for old in earlier[: max(0, len(earlier) + 1 - keep)]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    query = accesses.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return max(versions(spark, folder), default=-1)


def access_state(spark: SparkSession, source: str, name: str, schema, node: str, ts: str, folder: str | None = None) -> DataFrame:
    """The state after streaming the Parquet files called `name` in a folder, going on from the state in `folder` if there is one."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(source).select(F.col(node).alias("node"), F.col(ts).alias("ts"))
    folder = folder or new_folder(spark, "access")
    last = follow(spark, stream, folder)
    if last < 0:
        return advance(None, spark.createDataFrame([], stream.schema), 0)
    return spark.read.parquet(f"{folder}/v={last}")
