"""Plain-text export of chat sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.groups import ranked


def iso_time(ts: Column) -> Column:
    """ISO text; the fraction shows only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def export_transcripts(messages: DataFrame) -> DataFrame:
    """``[time] SENDER: content`` of every message with its ``position`` in the session's time order, from 1 on.

    A transcript is its lines joined by blank lines; it stays rows, so that no
    task holds a whole session, however long.
    """
    line = F.concat(
        F.lit("["), iso_time(F.col("created_at")), F.lit("] "), F.upper("sender_type"), F.lit(": "), F.col("content")
    )
    numbered = ranked(
        messages.select("tenant_id", "session_id", "created_at", "message_id", line.alias("line")),
        ["tenant_id", "session_id"],
        [F.asc("created_at"), F.asc("message_id")],
        F.date_trunc("HOUR", F.col("created_at")),
    )
    return numbered.select("tenant_id", "session_id", F.to_date("created_at").alias("day"), F.col("rn").cast("bigint").alias("position"), "line")


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    """Lines in folders by tenant and day, in order of session and position within each file.

    Folders follow tenants and days, never sessions; the rebalance hint splits a
    busy day over several files.
    """
    (
        transcripts.hint("rebalance", "tenant_id", "day")
        .sortWithinPartitions("tenant_id", "day", "session_id", "position")
        .write.mode("overwrite")
        .partitionBy("tenant_id", "day")
        .parquet(path)
    )
