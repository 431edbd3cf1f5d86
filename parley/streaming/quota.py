"""Running monthly message counts against the tenant's limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.functions.text import month_start
from parley.operators.analytics import with_limit
from parley.operators.groups import ranked
from parley.session import remove_dir

_KEYS = ["tenant_id", "month_start"]
_STATE = "tenant_id bigint, month_start timestamp_ntz, message_limit bigint, monthly_messages bigint, limit_hit_at timestamp_ntz"


def advance(batch: DataFrame, before: DataFrame, sessions: DataFrame, tenants: DataFrame) -> DataFrame:
    """Counts after a micro-batch.

    ``limit_hit_at`` is the time of the message that reached the limit; inside a
    batch messages count in time order.  Only tenants that cross the limit in
    this batch have their messages ranked, in two levels over hours.
    """
    known = sessions.where(F.col("visitor_id").isNotNull()).select("session_id")
    counted = (
        batch.where(F.col("sender_type") == "user")
        .join(known, "session_id", "left_semi")
        .select("tenant_id", "message_id", "created_at", month_start(F.col("created_at")).alias("month_start"))
    )
    added = counted.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("_added")).join(with_limit(tenants), "tenant_id")
    old = before.select(*_KEYS, F.col("monthly_messages").alias("_old"), "limit_hit_at", F.col("message_limit").alias("_old_limit"))
    totals = added.join(old, _KEYS, "full").select(
        *_KEYS,
        F.coalesce("message_limit", "_old_limit").alias("message_limit"),
        F.coalesce("_old", F.lit(0)).alias("_old"),
        (F.coalesce("_old", F.lit(0)) + F.coalesce("_added", F.lit(0))).alias("monthly_messages"),
        "limit_hit_at",
    )
    crossing = totals.where((F.col("_old") < F.col("message_limit")) & (F.col("monthly_messages") >= F.col("message_limit")))
    remaining = crossing.select(*_KEYS, (F.col("message_limit") - F.col("_old")).alias("_remaining"))
    order = [F.asc("created_at"), F.asc("message_id")]
    numbered = ranked(counted.join(remaining, _KEYS, "left_semi"), _KEYS, order, F.date_trunc("HOUR", F.col("created_at")), "_nth")
    hits = (
        numbered.join(remaining, _KEYS)
        .where(F.col("_nth") == F.col("_remaining"))
        .select(*_KEYS, F.col("created_at").alias("_hit"))
    )
    return totals.join(hits, _KEYS, "left").select(
        *_KEYS, "message_limit", "monthly_messages", F.coalesce("limit_hit_at", "_hit").alias("limit_hit_at")
    )


def quota_monitor(messages: DataFrame, sessions: DataFrame, tenants: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep ``path/version=<batch>`` up to date: one small row per tenant and month.

    Each batch reads the version before it and writes its own, so a replay
    starts from the same state and overwrites the same folder.  Two versions stay.
    """
    spark = messages.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        before = spark.createDataFrame([], _STATE) if batch_id == 0 else spark.read.schema(_STATE).parquet(f"{path}/version={batch_id - 1}")
        after = advance(batch, before, sessions, tenants)
        after.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        # a replay needs the version before its own; older ones are done with
        remove_dir(spark, f"{path}/version={batch_id - 2}")

    writer = messages.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).foreachBatch(step).start()


def read_quota(spark, path: str) -> DataFrame:
    """Counts after the newest batch."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version")).scalar()
    return versions.where(F.col("version") == newest).drop("version")
