"""Structured Streaming versions of keyed and windowed operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvine.session import ensure_checkpoint_dir


def limited(stream: DataFrame, key: str, time: str, row_id: str, seconds: float, limit: int) -> DataFrame:
    """The anchored limit on a stream: row_id, is_allowed. The state of a key is its window's begin and count.

    The rows that a key has in one micro-batch arrive in chunks of no order: they are put in order of
    time as a whole, two numbers a row in memory. A later micro-batch is taken as it arrives.
    """
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(row_id).cast("long").alias("row_id"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, used = state.get if state.exists else (None, 0)
        parts = [(b["time"].astype("int64").to_numpy() // 1000, b["row_id"].to_numpy()) for b in batches]
        times, ids = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((ids, times))
        for at in range(0, len(order), 10_000):
            chunk = order[at : at + 10_000]
            allowed = []
            for now in times[chunk].tolist():
                if begin is None or now >= begin + int(seconds * 1e6):
                    begin, used = now, 0
                allowed.append(used < limit)
                used += allowed[-1]
            yield pd.DataFrame({"row_id": ids[chunk], "is_allowed": allowed})
        state.update((begin, used))

    return rows.groupBy("key").applyInPandasWithState(step, "row_id long, is_allowed boolean", "begin long, used int", "append", GroupStateTimeout.NoTimeout)


def tumbling(stream: DataFrame, time: str, by: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and sum of values of each window and kind; rows later than the watermark are dropped. A window is given out once the watermark has passed its end: those that end after the latest time less ``late`` stay open."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything there is through the stream into a table of the shared folder, which is returned. In append mode windows that the watermark has not passed at the end are missing."""
    spark: SparkSession = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Everything there is through a stream of aggregates, also the windows still open at the end: of each key the row of the last micro-batch that changed it.

    A micro-batch that is run again after a failure overwrites its own folder.
    """
    spark: SparkSession = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    write = lambda rows, number: rows.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not query.lastProgress:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{base}/out")
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("__last")).select(*(c if c in keys else F.col(f"__last.{c}").alias(c) for c in stream.columns))


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file or folder as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
