"""Append-only logs: chat events, usage events, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.groups import in_order

CHAT_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("session_no", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_timestamp", T.TimestampNTZType()),
        T.StructField("user_message_text", T.StringType()),
        T.StructField("bot_response_text", T.StringType()),
        T.StructField("bot_response_source", T.StringType()),
        T.StructField("bot_response_confidence", T.DoubleType()),
        T.StructField("trigger_detection_method", T.StringType()),
        T.StructField("trigger_confidence", T.DoubleType()),
        T.StructField("trigger_matched_phrase", T.StringType()),
    ]
)


def to_chat_events(df: DataFrame) -> DataFrame:
    """Any subset of the event columns, completed with NULLs; a nested source becomes JSON text."""
    for field in df.schema:
        if field.name == "bot_response_source" and isinstance(field.dataType, (T.StructType, T.MapType)):
            df = df.withColumn(field.name, F.to_json(field.name))
    known = {f.name: f.dataType for f in CHAT_EVENT_SCHEMA}
    have = {f.name for f in df.schema}
    return df.select(
        *[(F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in known.items()]
    )


def append_events(df: DataFrame, path: str) -> None:
    to_chat_events(df).write.mode("append").parquet(path)


def event_history(sessions: DataFrame, events: DataFrame, ordered: bool = False) -> DataFrame:
    """Events of the given sessions, in time order if ``ordered``.

    ``source_json`` is the decoded source (VARIANT); where the text is not JSON
    it is NULL and ``source_text`` keeps the text.
    """
    decoded = F.try_parse_json("bot_response_source")
    rows = (
        events.join(sessions.select("session_no"), "session_no", "left_semi")
        .withColumns(
            {
                "source_json": decoded,
                "source_text": F.when(decoded.isNull(), F.col("bot_response_source")),
            }
        )
    )
    return in_order(rows, ordered, "session_no", "event_timestamp")


def to_usage_events(df: DataFrame, usage_type: str | Column, source: str | None = None) -> DataFrame:
    """One usage row per model call; missing token counts become 0, a missing model name empty."""
    kind = F.lit(usage_type) if isinstance(usage_type, str) else usage_type
    tokens = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)
    meta = F.lit("{}") if source is None else F.to_json(F.struct(F.lit(source).alias("source")))
    return df.select(
        "tenant_id",
        "session_id",
        kind.alias("usage_type"),
        F.coalesce(F.col("model_name"), F.lit("")).alias("model_name"),
        tokens("prompt_tokens"),
        tokens("completion_tokens"),
        tokens("total_tokens"),
        meta.alias("meta_json"),
        "created_at",
    )


def to_audit(
    changes: DataFrame,
    action: str | Column,
    target_type: str | Column,
    target_id: Column,
    details: list[Column],
    actor_id: Column | None = None,
    actor_role: str = "public",
) -> DataFrame:
    """Audit row per state change; ``details`` become a JSON object."""
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    return changes.select(
        (actor_id if actor_id is not None else F.lit(None)).cast("string").alias("actor_id"),
        F.lit(actor_role).alias("actor_role"),
        F.col("tenant_id"),
        text(action).alias("action"),
        text(target_type).alias("target_type"),
        target_id.cast("string").alias("target_id"),
        (F.to_json(F.struct(*details)) if details else F.lit("{}")).alias("details_json"),
    )
