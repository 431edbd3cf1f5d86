"""Rating prompts for idle sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.streaming import LATENESS

# Fixed values
DEFAULT_WAIT_SECONDS = 120
MIN_WAIT_SECONDS = 5


def idle_sessions(messages: DataFrame, tenants: DataFrame, ratings: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Prompt row when a session without rating sees no user message for its tenant's wait, at least 5 seconds.

    Batch and streaming input give the same rows; on a stream a prompt appears
    once the watermark has passed it (append mode).  Times are TIMESTAMP inside
    because watermarks need it, and zone-free outside.
    """
    sends = messages.where(F.col("sender_type") == "user").select(
        "tenant_id", "session_id", F.col("created_at").cast("timestamp").alias("ts")
    )
    if messages.isStreaming:
        sends = sends.withWatermark("ts", lateness)
    configured = F.coalesce(F.nullif(F.col("idle_rating_wait_seconds"), F.lit(0)), F.lit(DEFAULT_WAIT_SECONDS))
    waits = tenants.select("tenant_id", configured.alias("_wait"))
    wait = F.greatest(F.coalesce("_wait", F.lit(DEFAULT_WAIT_SECONDS)), F.lit(MIN_WAIT_SECONDS))
    timed = sends.join(waits, "tenant_id", "left").select(
        "tenant_id", "session_id", "ts", F.col("ts").alias("last"), wait.cast("bigint").alias("_wait")
    )
    if not messages.isStreaming:
        timed = _shrink(timed)
    gap = F.unix_micros("last") - F.unix_micros("ts") + F.col("_wait") * 1_000_000
    quiet = timed.withColumn("_gap", F.concat(gap.cast("string"), F.lit(" microseconds"))).groupBy(
        "tenant_id", "session_id", F.session_window("ts", F.col("_gap")).alias("w")
    ).agg(F.max("last").alias("last_activity_at"))
    rated = ratings.select("session_id", F.lit(True).alias("_rated"))
    return (
        quiet.join(rated, "session_id", "left")
        .where(F.col("_rated").isNull())
        .select(
            "tenant_id",
            "session_id",
            F.col("last_activity_at").cast("timestamp_ntz").alias("last_activity_at"),
            F.col("w.end").cast("timestamp_ntz").alias("prompt_at"),
        )
    )


def _shrink(timed: DataFrame) -> DataFrame:
    """Messages of a session inside one wait-long slot as their first and last time.

    They are closer together than the wait, so they belong to one window anyway;
    a session with very many messages reaches the window merge as few rows.
    """
    slot = F.floor(F.unix_micros("ts") / (F.col("_wait") * 1_000_000))
    slots = timed.groupBy("tenant_id", "session_id", "_wait", slot.alias("_slot"))
    return slots.agg(F.min("ts").alias("ts"), F.max("last").alias("last")).drop("_slot")
