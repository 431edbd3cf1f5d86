"""Running token sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.streaming import LATENESS

TOKENS = ["prompt_tokens", "completion_tokens", "total_tokens"]


def usage_rollup(usage: DataFrame, window: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Token sums by tenant and usage type, over all time or per tumbling ``window``; update mode on a stream."""
    keys = ["tenant_id", "usage_type"]
    rows = usage
    if window:
        rows = rows.withColumn("ts", F.col("created_at").cast("timestamp"))
        rows = rows.withWatermark("ts", lateness) if usage.isStreaming else rows
        keys = [*keys, F.window("ts", window).alias("window")]
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TOKENS])
