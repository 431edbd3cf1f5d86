"""Streams over the supplied files, run until all that is available has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.plans.matching_queries import BLOCKED_SQL, CLASSIFIED_SQL, TRIGGERS
from parley.plans.registry import query
from parley.session import shared_dir
from parley.streaming import sink
from parley.streaming.idle import idle_sessions
from parley.streaming.quota import quota_monitor, read_quota
from parley.streaming.screen import screen_messages
from parley.streaming.usage import usage_rollup


def _stream(b, table: str) -> DataFrame:
    """Stream of a supplied table; a file source takes a folder or a pattern, so the file is named by one."""
    schema = b.raw(table).schema
    return b.spark.readStream.schema(schema).parquet(f"{b.sf_dir}/{{{table}}}.parquet")


def _messages(b) -> DataFrame:
    """The message view over the stream of conversation rows."""
    conv, turn = F.col("conv_id"), F.col("turn")
    at = F.make_timestamp_ntz(
        F.lit(2024), (1 + conv % 3).cast("int"), (1 + conv % 28).cast("int"), (turn % 24).cast("int"), (conv % 60).cast("int"), F.lit(0)
    )
    return _stream(b, "conversations").select(
        (conv * 1000 + turn).alias("message_id"), conv.alias("session_id"), (conv % 25).alias("tenant_id"),
        F.col("role").alias("sender_type"), F.col("text").alias("content"), at.alias("created_at"),
    )


@query("stream_idle_sessions", """
with sends as (
  select m.tenant_id, m.session_id, m.created_at, greatest(coalesce(nullif(t.idle_rating_wait_seconds, 0), 120), 5) as wait,
    lead(m.created_at) over (partition by m.session_id order by m.created_at) as next_at
  from b_messages m left join b_tenants t using (tenant_id) where m.sender_type = 'user')
select tenant_id, session_id, created_at as last_activity_at, created_at + to_seconds(wait) as prompt_at from sends
where (next_at is null or next_at >= created_at + to_seconds(wait)) and session_id not in (select session_id from b_ratings)
  and created_at + to_seconds(wait) <= (select max(created_at) from sends) - interval 10 minute
""")
def stream_idle_sessions(b):
    path = shared_dir(b.spark, "idle")
    sink.drain(idle_sessions(_messages(b), b.tenants, b.ratings), path, "append")
    return b.spark.read.parquet(path).drop("batch_id")


@query("stream_quota_monitor", """
with counted as (
  select m.tenant_id, date_trunc('month', m.created_at)::timestamp as month_start, m.created_at,
    row_number() over (partition by m.tenant_id, date_trunc('month', m.created_at) order by m.created_at, m.message_id) as nth
  from b_messages m join b_sessions s using (session_id) where m.sender_type = 'user' and s.visitor_id is not null)
select c.tenant_id, c.month_start, t.message_limit, count(*) as monthly_messages, min(case when c.nth = t.message_limit then c.created_at end) as limit_hit_at
from counted c join (select tenant_id, cast(coalesce(nullif(monthly_message_limit, 0), 15000) as bigint) as message_limit from b_tenants) t using (tenant_id)
group by 1, 2, 3
""")
def stream_quota_monitor(b):
    path = shared_dir(b.spark, "quota")
    checkpoint = shared_dir(b.spark, "stream-state")
    quota_monitor(_messages(b), b.sessions, b.tenants, path, checkpoint, availableNow=True).awaitTermination()
    return read_quota(b.spark, path)


@query("stream_message_screen", f"""
select message_id, 'block_word' as kind, category as label, matched_word as phrase from ({BLOCKED_SQL})
union all select message_id, 'trigger', category, phrase from ({CLASSIFIED_SQL})
""")
def stream_message_screen(b):
    path = shared_dir(b.spark, "screen")
    texts = ["  Hello ", "helo", "thank  you", "Thanks!", "forbidden topic", "order no. 4711 please", "please stop-now at once"]
    picked = F.element_at(F.array(*map(F.lit, texts)), (F.col("message_id") % len(texts) + 1).cast("int"))
    both = F.array(
        F.struct(F.col("message_id").alias("id"), F.col("content").alias("said")), F.struct((-1 - F.col("message_id")).alias("id"), picked.alias("said"))
    )
    users = _messages(b).where(F.col("sender_type") == "user").drop("sender_type").withColumn("_said", F.explode(both))
    short = users.withColumns({"message_id": F.col("_said.id"), "content": F.col("_said.said")}).drop("_said")
    rules = b.block_rules
    sink.drain(short, path, "append", prepare=lambda batch: screen_messages(batch, rules, TRIGGERS))
    return b.spark.read.parquet(path).drop("batch_id")


@query("stream_usage_rollup", """
select tenant_id, usage_type, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens,
  cast(sum(total_tokens) as bigint) as total_tokens from b_usage group by 1, 2
""")
def stream_usage_rollup(b):
    path = shared_dir(b.spark, "usage")
    kind = F.col("event_type")
    usage_type = (
        F.when(kind == "click", "chat_completion").when(kind == "view", "chat_embedding").when(kind == "purchase", "index_embedding").otherwise(kind)
    )
    whole, half = F.floor("value").cast("bigint"), F.floor(F.col("value") / 2).cast("bigint")
    usage = _stream(b, "events").select(
        (F.col("user_id") % 25).alias("tenant_id"), usage_type.alias("usage_type"), whole.alias("prompt_tokens"),
        half.alias("completion_tokens"), (whole + half).alias("total_tokens"), F.col("ts").alias("created_at"),
    )
    sink.drain(usage_rollup(usage), path, "update")
    return sink.read_latest(b.spark, path, ["tenant_id", "usage_type"])
