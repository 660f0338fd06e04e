"""The one sequence of the 13/7/17 shift generator, drawn in parallel.

A step of the generator is linear over the bits of its state, so n steps are the n-th power of a 64 x 64 bit matrix. Powers of two
of it are made once by squaring; any offset is reached by those of its bits. A task jumps to its slice of the sequence, cuts it
into lanes that it jumps to as well, and steps all lanes at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Numbers of a slice, one task's work unit, and of a lane in it.
SLICE, LANE = 1 << 16, 1 << 7


def step(state: np.ndarray) -> np.ndarray:
    """The states after one step; they are the numbers drawn."""
    state = state ^ (state << np.uint64(13))
    state = state ^ (state >> np.uint64(7))
    return state ^ (state << np.uint64(17))


def times(matrix: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Each state by the matrix: the sum over its bits of the columns."""
    out = np.zeros_like(states)
    for bit in range(64):
        on = (states >> np.uint64(bit)) & np.uint64(1)
        out ^= on * matrix[bit]
    return out


@lru_cache(maxsize=1)
def powers() -> list[np.ndarray]:
    """The matrix of 2^k steps for k < 64, as the images of the single bits."""
    out = [step(np.uint64(1) << np.arange(64, dtype=np.uint64))]
    for _ in range(63):
        out.append(times(out[-1], out[-1]))
    return out


def jump(states: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Each state after its own number of steps."""
    steps = steps.astype(np.uint64)
    for k, matrix in enumerate(powers()):
        on = ((steps >> np.uint64(k)) & np.uint64(1)).astype(bool)
        if on.any():
            states = np.where(on, times(matrix, states), states)
    return states


def stretch(seed: int, first: int, n: int) -> np.ndarray:
    """The numbers first .. first + n - 1 of the sequence (the first is number 0)."""
    lanes = -(-n // LANE)
    state = jump(np.full(lanes, seed or 1, np.uint64), first + LANE * np.arange(lanes, dtype=np.uint64))
    out = np.empty((lanes, LANE), np.uint64)
    for i in range(LANE):
        state = step(state)
        out[:, i] = state
    return out.ravel()[:n]


def draws(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """i, value: the first n numbers. The unsigned ones are given by their bits, so the upper half are negative."""

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                values = stretch(seed, k * SLICE, min(SLICE, n - k * SLICE))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)) + k * SLICE), pa.array(values.view(np.int64))], ["i", "value"])

    return spark.range(-(-n // SLICE)).mapInArrow(run, "i long, value long")


def below(value: str, limit: int) -> Column:
    """The unsigned number modulo a limit below 2^31."""
    v = F.col(value)
    half = F.pmod(F.shiftrightunsigned(v, 1), F.lit(limit))
    return F.pmod(half * 2 + v.bitwiseAND(F.lit(1).cast("long")), F.lit(limit))


def planted(ids: DataFrame, seed: int, clusters: int, n: int) -> DataFrame:
    """node, cluster, next of ids(node), numbered 0 .. n - 1: each node is drawn into a cluster and linked to the next of it, so
    every cluster is a chain. A chain's links are found in ranges of the numbers, so no cluster is one task."""
    own = ids.join(draws(ids.sparkSession, seed, n).withColumnRenamed("i", "node"), "node").select("node", below("value", clusters).cast("int").alias("cluster"))
    part = F.floor(F.col("node") / SLICE)
    inside = own.withColumn("part", part).withColumn("next", F.lead("node").over(Window.partitionBy("cluster", "part").orderBy("node")))
    # the last of a range goes on with the first of the next range that has one: a row for each range and cluster
    firsts = inside.groupBy("cluster", "part").agg(F.min("node").alias("first"))
    after = firsts.select("cluster", "part", F.lead("first").over(Window.partitionBy("cluster").orderBy("part")).alias("after"))
    return inside.join(after, ["cluster", "part"]).select("node", "cluster", F.coalesce("next", "after").alias("next"))
