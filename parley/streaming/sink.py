"""Idempotent micro-batch output on shared storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from parley.operators.groups import newest
from parley.session import shared_dir


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str, prepare: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Write each micro-batch to its own folder; a replayed batch overwrites its earlier attempt."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).foreachBatch(write).start()


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row per key over all batches written in update mode."""
    return newest(spark.read.parquet(path), keys, ["batch_id"]).drop("batch_id")


def compact(spark: SparkSession, path: str, keys: list[str], into: str) -> None:
    """Write the newest row per key of all batches so far to ``into``, with the batch it comes from.

    For a stopped stream: go on with ``into`` and a fresh batch folder beside it.
    """
    newest(spark.read.parquet(path), keys, ["batch_id"]).write.mode("overwrite").parquet(into)


def drain(stream: DataFrame, path: str, mode: str, prepare=None) -> None:
    """Run a stream over what is available now and stop."""
    checkpoint = shared_dir(stream.sparkSession, "stream-state")
    write_batches(stream, path, checkpoint, mode, prepare, availableNow=True).awaitTermination()
