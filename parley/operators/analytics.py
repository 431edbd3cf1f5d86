"""Roll-ups over the conversation store, for all tenants at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import month_start
from parley.operators.groups import in_order, ranked, top_per_group

# Fixed values
USAGE_TYPES = ["chat_completion", "chat_embedding", "index_embedding"]
EMBEDDING_TYPES = ["chat_embedding", "index_embedding"]
DEFAULT_MONTHLY_LIMIT = 15_000
MAX_PAGE_SIZE = 100
TOP_ROWS = 100
PREVIEW_GROUPS = 20


def _votes(vote: str) -> Column:
    return F.count_if(F.col("vote") == vote)


def _zero(*names: str) -> dict[str, Column]:
    return {n: F.coalesce(F.col(n), F.lit(0)).cast("bigint") for n in names}


def tenant_overview(
    tenants: DataFrame,
    sessions: DataFrame,
    feedback: DataFrame,
    usage: DataFrame,
    ratings: DataFrame,
    approx_visitors: bool = False,
) -> DataFrame:
    """Chats, visitors, votes, token totals and ratings of every tenant; zero where absent.

    Each fact table is aggregated on its own before it meets the tenants, so the
    joins see one row per tenant.  ``approx_visitors`` swaps the exact distinct
    count for a sketch.  The mean is rounded half away from zero.
    """
    visitors = F.approx_count_distinct("visitor_id") if approx_visitors else F.count_distinct("visitor_id")
    per_session = sessions.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_chats"), visitors.alias("unique_visitors")
    )
    per_vote = feedback.groupBy("tenant_id").agg(_votes("up").alias("likes"), _votes("down").alias("dislikes"))
    tokens = lambda kinds: F.sum(F.when(F.col("usage_type").isin(kinds), F.col("total_tokens")).otherwise(0))
    per_usage = usage.groupBy("tenant_id").agg(
        tokens(EMBEDDING_TYPES).alias("embedding_token_usage"),
        tokens(["chat_completion"]).alias("chat_token_usage"),
    )
    per_rating = ratings.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("rating_count"), F.round(F.avg("rating"), 2).alias("average_rating")
    )
    out = tenants.select("tenant_id")
    for part in (per_session, per_vote, per_usage, per_rating):
        out = out.join(part, "tenant_id", "left")
    counts = ["total_chats", "unique_visitors", "embedding_token_usage", "chat_token_usage", "likes", "dislikes", "rating_count"]
    return out.withColumns(
        {**_zero(*counts), "average_rating": F.coalesce(F.col("average_rating"), F.lit(0.0))}
    ).select("tenant_id", *counts, "average_rating")


def usage_by_type(usage: DataFrame, tenants: DataFrame) -> DataFrame:
    """Token sums per tenant and usage type; known types are zero-filled, unknown ones kept."""
    names = ["prompt_tokens", "completion_tokens", "total_tokens"]
    sums = usage.groupBy("tenant_id", "usage_type").agg(*[F.sum(n).alias(n) for n in names])
    known = tenants.select("tenant_id", F.explode(F.lit(USAGE_TYPES)).alias("usage_type"))
    zeros = known.withColumns({n: F.lit(0).cast("bigint") for n in names})
    return (
        sums.join(tenants.select("tenant_id"), "tenant_id", "left_semi")
        .unionByName(zeros)
        .groupBy("tenant_id", "usage_type")
        .agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    )


def usage_embedding_total(usage: DataFrame) -> DataFrame:
    """Chat plus index embedding tokens per tenant."""
    is_embedding = F.col("usage_type").isin(EMBEDDING_TYPES)
    return usage.groupBy("tenant_id").agg(
        F.coalesce(F.sum(F.when(is_embedding, F.col("total_tokens"))), F.lit(0)).alias("embedding_total_tokens")
    )


def usage_per_session(usage: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    """Sessions with the most tokens, top ``n`` per tenant; ties by session id."""
    sums = (
        usage.where(F.col("session_id").isNotNull())
        .groupBy("tenant_id", "session_id")
        .agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"))
    )
    return top_per_group(sums, ["tenant_id"], [F.desc("total_tokens"), F.asc("session_id")], n, "rank")


def usage_per_tenant(usage: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    """Tenants with the most tokens, top ``n``; ties by tenant id."""
    sums = usage.groupBy("tenant_id").agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"))
    return sums.orderBy(F.desc("total_tokens"), F.asc("tenant_id")).limit(n)


def feedback_by_message(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("message_id").agg(_votes("up").alias("up"), _votes("down").alias("down"))


def feedback_by_session(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Votes per session through the message -> session map; votes are summed per message first."""
    return (
        feedback_by_message(feedback)
        .join(messages.select("message_id", "session_id"), "message_id")
        .groupBy("session_id")
        .agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    )


def session_listing(sessions: DataFrame, messages: DataFrame, feedback: DataFrame, ordered: bool = False) -> DataFrame:
    """Sessions with message and vote counts, newest first if ``ordered``."""
    counts = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"))
    rows = (
        sessions.join(counts, "session_id", "left")
        .join(feedback_by_session(messages, feedback), "session_id", "left")
        .withColumns(_zero("message_count", "up", "down"))
    )
    return in_order(rows, ordered, F.desc("last_message_at"), F.asc("session_id"))


def feedback_page_total(page: DataFrame) -> DataFrame:
    """Votes over a page of the session listing."""
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    return page.agg(total("up"), total("down"))


def message_detail(messages: DataFrame, feedback: DataFrame, ordered: bool = False) -> DataFrame:
    """Messages with their votes, in time order if ``ordered``; a missing token record is ``{}``."""
    rows = (
        messages.join(feedback_by_message(feedback), "message_id", "left")
        .withColumns({**_zero("up", "down"), "token_usage_json": F.coalesce("token_usage_json", F.lit("{}"))})
    )
    return in_order(rows, ordered, "session_id", "created_at", "message_id")


def visitor_rollup(sessions: DataFrame, ordered: bool = False) -> DataFrame:
    """One row per visitor: newest non-empty name and e-mail, first and last seen, chats; newest first if ``ordered``."""
    key = "struct(last_message_at, session_id)"
    known = sessions.where(F.coalesce("visitor_id", F.lit("")) != "")
    rows = (
        known.groupBy("tenant_id", "visitor_id")
        .agg(
            F.expr(f"max_by(visitor_name, {key}) filter (where visitor_name <> '')").alias("name"),
            F.expr(f"max_by(visitor_email, {key}) filter (where visitor_email <> '')").alias("email"),
            F.min("started_at").alias("first_seen_at"),
            F.max("last_message_at").alias("last_seen_at"),
            F.count(F.lit(1)).alias("chat_count"),
        )
    )
    return in_order(rows, ordered, F.desc("last_seen_at"), F.asc("tenant_id"), F.asc("visitor_id"))


def visitor_sessions(sessions: DataFrame, messages: DataFrame, feedback: DataFrame, visitor_id: str | None = None, ordered: bool = False) -> DataFrame:
    """Sessions of one visitor (or of every visitor) with vote counts, newest first if ``ordered``."""
    picked = sessions.where(F.col("visitor_id").isNotNull() if visitor_id is None else F.col("visitor_id") == visitor_id)
    own = messages if visitor_id is None else messages.join(picked.select("session_id"), "session_id", "left_semi")
    rows = (
        picked.join(feedback_by_session(own, feedback), "session_id", "left")
        .withColumns(_zero("up", "down"))
        .select("tenant_id", "visitor_id", "session_id", "title", "last_message_at", "up", "down")
    )
    return in_order(rows, ordered, F.desc("last_message_at"), F.asc("session_id"))


def clamp_page(page: int, size: int) -> tuple[int, int]:
    return max(page, 1), max(1, min(size, MAX_PAGE_SIZE))


def paginate(df: DataFrame, keys: list[str], order: list[Column], page: int = 1, size: int = 20) -> DataFrame:
    """One page per group with its position and the group's total.

    The position filter lets Spark keep only the leading rows of each group on
    the map side; the total is a separate count, not a window.  For pages far
    down a long list use :func:`page_after`.
    """
    page, size = clamp_page(page, size)
    first = (page - 1) * size
    rows = top_per_group(df, keys, order, first + size, "position").where(F.col("position") > first)
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return rows.join(totals, keys)


def page_after(df: DataFrame, keys: list[str], order: list[Column], after: Column, size: int = 20) -> DataFrame:
    """Keyset page: the first ``size`` rows per group for which ``after`` holds."""
    return top_per_group(df.where(after), keys, order, clamp_page(1, size)[1], "position")


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if(F.col("status") == "running").alias("active_jobs")
    )


def ingest_summary(statuses: DataFrame) -> DataFrame:
    """Documents, successes and failures per tenant and run."""
    return statuses.groupBy("tenant_id", "run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def job_progress(df: DataFrame) -> DataFrame:
    """Percentage (0 for an empty run) and elapsed seconds (0 before the start)."""
    percent = F.when(F.col("total_items") > 0, F.col("processed_items") / F.col("total_items") * 100).otherwise(F.lit(0.0))
    started = F.col("start_time") > 0
    elapsed = F.when(started, F.col("last_update_time") - F.col("start_time")).otherwise(F.lit(0.0))
    return df.withColumns({"progress_percentage": percent, "elapsed_time": elapsed})


def _visitor_messages(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    known = sessions.where(F.col("visitor_id").isNotNull()).select("session_id")
    return messages.where(F.col("sender_type") == "user").join(known, "session_id", "left_semi")


def with_limit(tenants: DataFrame) -> DataFrame:
    """Tenant id and monthly limit; 0 and NULL mean the default."""
    limit = F.coalesce(F.nullif(F.col("monthly_message_limit"), F.lit(0)), F.lit(DEFAULT_MONTHLY_LIMIT))
    return tenants.select("tenant_id", limit.cast("bigint").alias("message_limit"))


def quota_usage(messages: DataFrame, sessions: DataFrame, tenants: DataFrame) -> DataFrame:
    """User messages of known visitors per tenant and UTC month against the tenant's limit.

    Messages are counted per session and month before the join, so a very long
    session crosses the network as one row.
    """
    per_session = (
        messages.where(F.col("sender_type") == "user")
        .groupBy("tenant_id", "session_id", month_start(F.col("created_at")).alias("month_start"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = sessions.where(F.col("visitor_id").isNotNull()).select("session_id")
    return (
        per_session.join(known, "session_id", "left_semi")
        .groupBy("tenant_id", "month_start")
        .agg(F.sum("n").alias("monthly_messages"))
        .join(with_limit(tenants), "tenant_id")
        .withColumn("exceeded", F.col("monthly_messages") >= F.col("message_limit"))
    )


def quota_first_hit(messages: DataFrame, sessions: DataFrame, tenants: DataFrame) -> DataFrame:
    """Monthly count per tenant and the instant of the message that reached the limit (NULL if none did).

    The limit-th message is found by two-level ranking over hours, so a tenant
    with a large part of all messages does not fall into one task.
    """
    counted = _visitor_messages(messages, sessions).select(
        "tenant_id", "message_id", "created_at", month_start(F.col("created_at")).alias("month_start")
    )
    numbered = ranked(
        counted,
        ["tenant_id", "month_start"],
        [F.asc("created_at"), F.asc("message_id")],
        F.date_trunc("HOUR", F.col("created_at")),
        "nth",
    )
    return (
        numbered.join(with_limit(tenants), "tenant_id")
        .groupBy("tenant_id", "month_start", "message_limit")
        .agg(
            F.count(F.lit(1)).alias("monthly_messages"),
            F.min(F.when(F.col("nth") == F.col("message_limit"), F.col("created_at"))).alias("limit_hit_at"),
        )
    )
