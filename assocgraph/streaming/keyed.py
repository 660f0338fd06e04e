"""Access state in Spark's own state store: a batch touches the nodes that it holds and no others.

Per node the store keeps the number of accesses, the time of the last one and whether the node is alive. A node that nobody
reads for `idle` (of event time, once the watermark is past it) is no longer alive; a later access brings it back. What
changes goes to the output in each batch; the whole state is read from the checkpoint by the state data source.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import new_folder

STATE = "n long, last_ms long, alive boolean"
OUTPUT = "node long, n long, last_ms long, alive boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTS = "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Accesses(StatefulProcessor):
    """Counts accesses and lets nodes fall asleep."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.access = handle, handle.getValueState("access", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = 0, None
        for part in rows:
            n += len(part)
            latest = part["ms"].max()
            last = last if pd.isna(latest) else int(latest) if last is None else max(last, int(latest))
        if self.access.exists():
            before = self.access.get()
            n, last = n + before[0], before[1] if last is None else last if before[1] is None else max(last, before[1])
            if before[1] is not None and before[1] != last:
                self.handle.deleteTimer(before[1] + self.idle_ms)
        # an access that comes so late that its time is over leaves the node asleep
        alive = last is None or last + self.idle_ms > timerValues.getCurrentWatermarkInMs()
        if last is not None and alive:
            self.handle.registerTimer(last + self.idle_ms)
        self.access.update((n, last, alive))
        yield self._row(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, last, _ = self.access.get()
        self.access.update((n, last, False))
        yield self._row(key)

    def _row(self, key) -> pd.DataFrame:
        n, last, alive = self.access.get()
        return pd.DataFrame({"node": pd.array([key[0]], "Int64"), "n": [n], "last_ms": pd.array([last], "Int64"), "alive": [alive]})

    def close(self) -> None:
        pass


def changes(accesses: DataFrame, idle: timedelta, late: str = "0 seconds") -> DataFrame:
    """node, n, last_ms, alive of what each batch of the stream accesses(node, ts) changes. Accesses may come `late` by so much."""
    # times without a zone count as UTC
    zoned = accesses.schema["ts"].dataType.typeName() != "timestamp_ntz"
    ms = F.unix_millis("ts") if zoned else F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    timed = accesses.select(F.col("node").cast("long").alias("node"), ms.alias("ms")).withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", late)
    return timed.groupBy("node").transformWithStateInPandas(Accesses(int(idle.total_seconds() * 1000)), OUTPUT, "Update", "EventTime")


def follow(accesses: DataFrame, idle: timedelta, folder: str, sink=None) -> None:
    """Run the stream to the end of what is there; offsets and state are in the folder, and a later call goes on from them.

    sink: a function of (batch of changes, number), none to keep the state only.
    """
    spark = accesses.sparkSession
    # the state has as many parts as there are cores, for as long as the folder lasts
    own = {PROVIDER: ROCKS, PARTS: str(spark.sparkContext.defaultParallelism)}
    kept = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        # where a batch is written again after a failure it holds the same changes
        query = changes(accesses, idle).writeStream.outputMode("update").foreachBatch(sink or (lambda batch, number: batch.write.format("noop").mode("append").save())).option("checkpointLocation", folder).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state(spark: SparkSession, folder: str) -> DataFrame:
    """node, n, last_ms, alive of all nodes, from the checkpoint."""
    rows = spark.read.format("statestore").option("stateVarName", "access").load(folder)
    return rows.select(F.col("key.node").alias("node"), "value.n", "value.last_ms", "value.alive")


def access_state(spark: SparkSession, source: str, name: str, schema, node: str, ts: str, idle: timedelta, folder: str | None = None) -> DataFrame:
    """The state after streaming the Parquet files called `name` in a folder, going on from the state in `folder` if there is one."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(source).select(F.col(node).alias("node"), F.col(ts).alias("ts"))
    folder = folder or new_folder(spark, "access")
    follow(stream, idle, folder)
    return state(spark, folder)
