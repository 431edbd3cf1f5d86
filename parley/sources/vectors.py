"""Vector collection on parquet, laid out by tenant and source type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.operators.groups import newest

LAYOUT = ["tenant_id", "source_type"]


def latest_points(points: DataFrame, order: str = "seq") -> DataFrame:
    """One row per tenant, source type and point id: the last write wins."""
    return newest(points, [*LAYOUT, "point_id"], [order])


def upsert_vectors(points: DataFrame, path: str, order: str = "seq", touched: DataFrame | None = None) -> None:
    """Replace the (tenant, source type) partitions in ``points`` and ``touched``; leave the others alone.

    A dynamic overwrite replaces partition after partition when the job commits;
    a partition of ``touched`` without points gets one row without id, which
    :func:`read_vectors` does not show.  The rebalance hint splits a hot partition
    over several files and merges small ones.
    """
    latest = latest_points(points, order)
    if touched is not None:
        empty = touched.select(*LAYOUT).distinct().join(points.select(*LAYOUT).distinct(), LAYOUT, "left_anti")
        latest = latest.unionByName(empty, allowMissingColumns=True)
    (
        latest
        .hint("rebalance", *LAYOUT)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*LAYOUT)
        .parquet(path)
    )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The collection; filters on tenant and source type prune partitions."""
    return spark.read.parquet(path).where("point_id is not null")
