"""The message cascade: block words, quick replies, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import block_words, quick_replies, retrieval
from parley.session import materialize

# Fixed values
NO_CONTEXT = "I could not find high-confidence context for that request."
BLOCK, FUZZY, VECTOR = "block_word", "fuzzy", "vector_search"


def route(
    messages: DataFrame,
    queries: DataFrame,
    block_rules: DataFrame,
    reply_rules: DataFrame,
    tenants: DataFrame,
    vectors: DataFrame,
    k: int = retrieval.TOP_K,
    public: bool = True,
    tags: DataFrame | None = None,
) -> DataFrame:
    """Source, confidence and fixed response of every message, exactly one row each.

    Stages run in order and a message leaves at the first that answers; only the
    rest reaches the block product.  ``queries`` has one vector per message id.
    Non-public traffic skips the block words.  ``response`` is NULL where an
    answer must be generated from the context.  ``tags`` has each tenant's own
    source type and fallback URL.
    """
    asked = messages.select("message_id", "session_id", "tenant_id", "content", "created_at")
    replies = quick_replies.match_quick_replies(asked, reply_rules, tenants).select(
        "message_id", F.lit(1).alias("stage"), F.lit(FUZZY).alias("source"), "confidence", "response"
    )
    early = replies
    if public:
        blocked = block_words.match_block_words(asked, block_rules).select(
            "message_id", F.lit(0).alias("stage"), F.lit(BLOCK).alias("source"), F.lit(1.0).alias("confidence"),
            F.col("response_message").alias("response"),
        )
        early = blocked.unionByName(replies)
    first = early.groupBy("message_id").agg(F.min(F.struct("stage", "source", "confidence", "response")).alias("e"))
    answered = materialize(first.select("message_id", "e.source", "e.confidence", "e.response"), "routes")

    open_queries = queries.join(answered.select(F.col("message_id").alias("query_id")), "query_id", "left_anti")
    filtered = retrieval.min_score(retrieval.two_bucket(open_queries, vectors, k, tags))
    # a hit is cited unless its URL is empty or cannot be read at all
    found = retrieval.cited_best(filtered, vectors, tags).select(F.col("query_id").alias("message_id"), "best")
    out = asked.join(answered, "message_id", "left").join(found, "message_id", "left")
    by_vector = F.col("source").isNull()
    return out.select(
        "message_id",
        "session_id",
        "tenant_id",
        "created_at",
        F.coalesce("source", F.lit(VECTOR)).alias("source"),
        F.when(by_vector, F.coalesce("best", F.lit(0.0))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(by_vector & F.col("best").isNull(), F.lit(NO_CONTEXT)).otherwise(F.col("response")).alias("response"),
    )


def flag_sessions(sessions: DataFrame, routed: DataFrame) -> DataFrame:
    """Sessions with the block flag and last activity after a batch of routed messages."""
    seen = routed.groupBy("session_id").agg(
        F.bool_or(F.col("source") == BLOCK).alias("_blocked"), F.max("created_at").alias("_last")
    )
    return (
        sessions.join(seen, "session_id", "left")
        .withColumns(
            {
                "block_triggered": F.coalesce("_blocked", F.lit(False)),
                "last_message_at": F.greatest("last_message_at", "_last"),
            }
        )
        .drop("_blocked", "_last")
    )
