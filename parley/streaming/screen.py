"""Screening of a message stream by block words and triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.block_words import match_block_words
from parley.operators.triggers import TriggerSet, classify_triggers


def screen_messages(messages: DataFrame, block_rules: DataFrame, triggers: TriggerSet) -> DataFrame:
    """One row per message and kind of hit: the block rule, the trigger, or both."""
    blocked = match_block_words(messages, block_rules).select(
        "message_id", F.lit("block_word").alias("kind"), F.col("category").alias("label"), F.col("matched_word").alias("phrase")
    )
    triggered = classify_triggers(messages, triggers).select(
        "message_id", F.lit("trigger").alias("kind"), F.col("category").alias("label"), "phrase"
    )
    return blocked.unionByName(triggered)
