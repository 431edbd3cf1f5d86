"""Queries over roll-ups, listings and rankings of the conversation store."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import analytics as an
from parley.plans.registry import query


@query("tenant_overview", """
select t.tenant_id, coalesce(s.n, 0) as total_chats, coalesce(s.v, 0) as unique_visitors,
  cast(coalesce(u.emb, 0) as bigint) as embedding_token_usage, cast(coalesce(u.chat, 0) as bigint) as chat_token_usage,
  cast(coalesce(f.up, 0) as bigint) as likes, cast(coalesce(f.down, 0) as bigint) as dislikes,
  coalesce(r.n, 0) as rating_count, coalesce(r.avg_rating, 0.0) as average_rating
from b_tenants t
left join (select tenant_id, count(*) as n, count(distinct visitor_id) as v from b_sessions group by 1) s using (tenant_id)
left join (select tenant_id, sum(case when vote = 'up' then 1 else 0 end) as up, sum(case when vote = 'down' then 1 else 0 end) as down
  from b_feedback group by 1) f using (tenant_id)
left join (select tenant_id, sum(case when usage_type in ('chat_embedding', 'index_embedding') then total_tokens else 0 end) as emb,
  sum(case when usage_type = 'chat_completion' then total_tokens else 0 end) as chat from b_usage group by 1) u using (tenant_id)
left join (select tenant_id, count(*) as n, round(avg(rating), 2) as avg_rating from b_ratings group by 1) r using (tenant_id)
""")
def tenant_overview(b):
    return an.tenant_overview(b.tenants, b.sessions, b.feedback, b.usage, b.ratings)


@query("usage_summary_by_type", """
with known as (select tenant_id, unnest(['chat_completion', 'chat_embedding', 'index_embedding']) as usage_type from b_tenants),
found as (select distinct u.tenant_id, u.usage_type from b_usage u join b_tenants using (tenant_id))
select k.tenant_id, k.usage_type, cast(coalesce(sum(prompt_tokens), 0) as bigint) as prompt_tokens,
  cast(coalesce(sum(completion_tokens), 0) as bigint) as completion_tokens, cast(coalesce(sum(total_tokens), 0) as bigint) as total_tokens
from (select * from known union select * from found) k left join b_usage u on u.tenant_id = k.tenant_id and u.usage_type = k.usage_type
group by 1, 2
""")
def usage_summary_by_type(b):
    return an.usage_by_type(b.usage, b.tenants)


@query("usage_embedding_total", """
select tenant_id, cast(sum(case when usage_type in ('chat_embedding', 'index_embedding') then total_tokens else 0 end) as bigint) as embedding_total_tokens
from b_usage group by 1
""")
def usage_embedding_total(b):
    return an.usage_embedding_total(b.usage)


@query("usage_per_session_top", """
select tenant_id, session_id, total_tokens, rank from (
  select *, row_number() over (partition by tenant_id order by total_tokens desc, session_id) as rank from (
    select tenant_id, session_id, cast(sum(total_tokens) as bigint) as total_tokens from b_usage where session_id is not null group by 1, 2))
where rank <= 100
""")
def usage_per_session_top(b):
    return an.usage_per_session(b.usage)


@query("usage_per_tenant", """
select tenant_id, cast(sum(total_tokens) as bigint) as total_tokens from b_usage group by 1 order by 2 desc, 1 limit 100
""")
def usage_per_tenant(b):
    return an.usage_per_tenant(b.usage)


_FEEDBACK_BY_SESSION = """
select m.session_id, cast(sum(case when f.vote = 'up' then 1 else 0 end) as bigint) as up,
  cast(sum(case when f.vote = 'down' then 1 else 0 end) as bigint) as down
from b_feedback f join b_messages m using (message_id) group by 1
"""

_LISTING = f"""
select s.tenant_id, s.session_id, s.title, s.visitor_name, s.visitor_email, s.last_message_at,
  coalesce(c.n, 0) as message_count, coalesce(f.up, 0) as up, coalesce(f.down, 0) as down
from b_sessions s
left join (select session_id, count(*) as n from b_messages group by 1) c using (session_id)
left join ({_FEEDBACK_BY_SESSION}) f using (session_id)
"""


@query("session_listing", _LISTING)
def session_listing(b):
    return an.session_listing(b.sessions, b.messages, b.feedback).select(
        "tenant_id", "session_id", "title", "visitor_name", "visitor_email", "last_message_at", "message_count", "up", "down"
    )


@query("feedback_by_session", _FEEDBACK_BY_SESSION)
def feedback_by_session(b):
    return an.feedback_by_session(b.messages, b.feedback)


@query("feedback_by_message", """
select message_id, count(*) filter (where vote = 'up') as up, count(*) filter (where vote = 'down') as down from b_feedback group by 1
""")
def feedback_by_message(b):
    return an.feedback_by_message(b.feedback)


@query("feedback_page_total", f"""
select cast(sum(up) as bigint) as up, cast(sum(down) as bigint) as down from (
  select *, row_number() over (partition by tenant_id order by last_message_at desc, session_id) as rn from ({_LISTING}))
where rn <= 20
""")
def feedback_page_total(b):
    listing = an.session_listing(b.sessions, b.messages, b.feedback)
    page = an.paginate(listing, ["tenant_id"], [F.desc("last_message_at"), F.asc("session_id")], 1, 20)
    return an.feedback_page_total(page)


@query("message_detail", """
select m.message_id, m.session_id, m.sender_type, m.content, m.created_at, coalesce(m.token_usage_json, '{}') as token_usage_json,
  coalesce(f.up, 0) as up, coalesce(f.down, 0) as down
from b_messages m left join (
  select message_id, count(*) filter (where vote = 'up') as up, count(*) filter (where vote = 'down') as down from b_feedback group by 1) f
using (message_id)
""")
def message_detail(b):
    return an.message_detail(b.messages, b.feedback).select(
        "message_id", "session_id", "sender_type", "content", "created_at", "token_usage_json", "up", "down"
    )


@query("visitor_rollup", """
select tenant_id, visitor_id,
  first(visitor_name order by last_message_at desc, session_id desc) filter (where visitor_name <> '') as name,
  first(visitor_email order by last_message_at desc, session_id desc) filter (where visitor_email <> '') as email,
  min(started_at) as first_seen_at, max(last_message_at) as last_seen_at, count(*) as chat_count
from b_sessions where visitor_id <> '' group by 1, 2
""")
def visitor_rollup(b):
    return an.visitor_rollup(b.sessions)


@query("visitor_sessions", f"""
select s.tenant_id, s.visitor_id, s.session_id, s.title, s.last_message_at, coalesce(f.up, 0) as up, coalesce(f.down, 0) as down
from b_sessions s left join ({_FEEDBACK_BY_SESSION}) f using (session_id) where s.visitor_id is not null
""")
def visitor_sessions(b):
    return an.visitor_sessions(b.sessions, b.messages, b.feedback)


@query("paginate", """
select tenant_id, message_id, position, total from (
  select tenant_id, message_id, row_number() over (partition by tenant_id order by created_at desc, message_id) as position,
    count(*) over (partition by tenant_id) as total from b_messages)
where position between 4 and 6
""")
def paginate(b):
    order = [F.desc("created_at"), F.asc("message_id")]
    return an.paginate(b.messages, ["tenant_id"], order, page=2, size=3).select("tenant_id", "message_id", "position", "total")


@query("reindex_job_counts", """
select count(*) as total_jobs, count(*) filter (where status = 'running') as active_jobs from b_jobs
""")
def reindex_job_counts(b):
    return an.job_counts(b.jobs)


@query("ingest_result_summary", """
select tenant_id, run_id, count(*) as total, count(*) filter (where status = 'succeeded') as succeeded,
  count(*) filter (where status = 'failed') as failed from b_ingest_status group by 1, 2
""")
def ingest_result_summary(b):
    return an.ingest_summary(b.ingest_status)


@query("job_progress_metrics", """
select event_id, case when user_id % 7 > 0 then (user_id % 7) / 2.0 / (user_id % 7) * 100 else 0.0 end as progress_percentage,
  case when value > 100 then value / 2 else 0.0 end as elapsed_time from events
""")
def job_progress_metrics(b):
    runs = b.raw("events").select(
        "event_id",
        (F.col("user_id") % 7).alias("total_items"),
        ((F.col("user_id") % 7) / F.lit(2.0)).alias("processed_items"),
        F.when(F.col("value") > 100, F.col("value") / 2).otherwise(F.lit(0.0)).alias("start_time"),
        F.col("value").alias("last_update_time"),
    )
    return an.job_progress(runs).select("event_id", "progress_percentage", "elapsed_time")


@query("quota_usage", """
select tenant_id, month_start, n as monthly_messages, message_limit, n >= message_limit as exceeded from (
  select m.tenant_id, date_trunc('month', m.created_at)::timestamp as month_start, count(*) as n
  from b_messages m join b_sessions s using (session_id)
  where m.sender_type = 'user' and s.visitor_id is not null group by 1, 2) u
join (select tenant_id, cast(coalesce(nullif(monthly_message_limit, 0), 15000) as bigint) as message_limit from b_tenants) t using (tenant_id)
""")
def quota_usage(b):
    return an.quota_usage(b.messages, b.sessions, b.tenants)


@query("month_bounds", """
select event_id, date_trunc('month', ts)::timestamp as month_start, (date_trunc('month', ts) + interval 1 month)::timestamp as next_month_start from events
""")
def month_bounds(b):
    from parley.functions.text import month_start, next_month_start

    return b.raw("events").select(
        "event_id", month_start(F.col("ts")).alias("month_start"), next_month_start(F.col("ts")).alias("next_month_start")
    )


@query("confidence_percent", """
select event_id, cast(floor(value / 500 * 100 + 0.5) as bigint) as confidence_pct from events
""")
def confidence_percent(b):
    from parley.functions.text import confidence_pct

    return b.raw("events").select("event_id", confidence_pct(F.col("value") / 500).alias("confidence_pct"))
