"""Queries over scans, sinks and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import ids, urls
from parley.plans import sql_parts as sql
from parley.plans.document_queries import SITE_DEFAULT
from parley.plans.registry import query
from parley.session import shared_dir
from parley.sources import cms, events, transcripts, vectors


@query("scan_published_posts", """
select id, tenant_id, title, content, type, post_name, post_date from b_posts where status = 'publish' and content <> '' order by post_date desc
""")
def scan_published_posts(b):
    return cms.scan_posts(b.posts, newest_first=True)


@query("site_url_lookup", sql.SITES)
def site_url_lookup(b):
    return cms.site_url(b.options, b.tenants, SITE_DEFAULT)


@query("scan_external_urls", f"""
select id, tenant_id, {sql.fixed('url')} as url, concat('External content from ', {sql.fixed('url')}) as title,
  concat('External content fetched from ', {sql.fixed('url')}) as description from b_urls
""")
def scan_external_urls(b):
    return cms.scan_urls(b.urls)


@query("source_options_from_dsn", r"""
select tenant_id, source_table_prefix as table_prefix, source_url_table as url_table,
  case when d is not null then regexp_extract(d, '@([^:/]*)', 1) end as host,
  case when d is not null then coalesce(try_cast(nullif(regexp_extract(d, '@[^:/]*:([0-9]+)', 1), '') as int), 3306) end as port,
  case when d is not null then regexp_extract(d, '//[^/]*/(.*)$', 1) end as database,
  nullif(regexp_extract(d, '//([^:]*):', 1), '') as "user",
  nullif(url_decode(regexp_extract(d, '//[^:]*:([^@]*)@', 1)), '') as password
from (select *, nullif(source_db_url, '') as d from b_tenants)
""")
def source_options_from_dsn(b):
    return cms.parse_dsn(b.tenants, "source_db_url").select(
        "tenant_id", "table_prefix", "url_table", "host", "port", "database", "user", "password"
    )


@query("tenants_due_for_reindex", f"""
select t.* from ({sql.TAGS}) t join b_tenants b using (tenant_id) where b.status = 'active' and b.source_db_url <> ''
""")
def tenants_due_for_reindex(b):
    return cms.due_tenants(b.tenants)


_URL_POINTS = f"""
select tenant_id, 'external' as source_type, {sql.uuid5('url')} as point_id, id as seq, url from (
  select id, tenant_id, {sql.fixed('url')} as url from b_urls) where url <> ''
"""


@query("vector_upsert", f"""
select tenant_id, 'primary' as source_type, {sql.uuid5("concat('wp_', cast(id as varchar))")} as point_id, id as seq, title as payload from b_posts
union all
select tenant_id, source_type, point_id, max(seq), concat('new ', arg_max(url, seq)) from ({_URL_POINTS}) group by 1, 2, 3
""")
def vector_upsert(b):
    path = shared_dir(b.spark, "vectors")
    listed = b.urls.select("tenant_id", F.col("id").alias("seq"), urls.fix_url(F.col("url")).alias("url")).where("url <> ''")
    external = listed.select(
        "tenant_id", F.lit("external").alias("source_type"), ids.url_point_id(F.col("url")).alias("point_id"), "seq", F.col("url").alias("payload")
    )
    primary = b.posts.select(
        "tenant_id", F.lit("primary").alias("source_type"), ids.cms_point_id(F.col("id")).alias("point_id"),
        F.col("id").alias("seq"), F.col("title").alias("payload"),
    )
    vectors.upsert_vectors(primary.unionByName(external), path)
    vectors.upsert_vectors(external.withColumn("payload", F.concat(F.lit("new "), F.col("payload"))), path)
    return vectors.read_vectors(b.spark, path).select(
        F.col("tenant_id").cast("bigint").alias("tenant_id"), "source_type", "point_id", "seq", "payload"
    )


@query("chat_event_append", """
select user_id as session_no, event_type, ts as event_timestamp,
  case when event_type in ('click', 'view') then concat('text ', cast(event_id as varchar)) end as user_message_text,
  case when event_type not in ('click', 'view') then 'plain note' else concat('{"value":', cast(event_id as varchar), '}') end as bot_response_source
from events
""")
def chat_event_append(b):
    path = shared_dir(b.spark, "chat-events")
    rows = b.raw("events").select(
        "event_id", F.col("user_id").alias("session_no"), "event_type", F.col("ts").alias("event_timestamp")
    )
    with_text = F.col("event_type").isin("click", "view")
    nested = rows.where(with_text).withColumns(
        {
            "user_message_text": F.concat(F.lit("text "), F.col("event_id").cast("string")),
            "bot_response_source": F.struct(F.col("event_id").alias("value")),
        }
    )
    plain = rows.where(~with_text).withColumn("bot_response_source", F.lit("plain note"))
    events.append_events(nested, path)
    events.append_events(plain, path)
    return b.spark.read.schema(events.CHAT_EVENT_SCHEMA).parquet(path).select(
        "session_no", "event_type", "event_timestamp", "user_message_text", "bot_response_source"
    )


@query("chat_event_history", """
select e.session_no, e.event_id, e.event_type, e.event_timestamp,
  case when json_valid(e.bot_response_source) then cast(json_extract_string(e.bot_response_source, '$.k') as bigint) end as source_k,
  case when not json_valid(e.bot_response_source) then e.bot_response_source end as source_text
from b_chat_events e
""")
def chat_event_history(b):
    sessions = b.chat_events.select("session_no").distinct()
    return events.event_history(sessions, b.chat_events).select(
        "session_no",
        "event_id",
        "event_type",
        "event_timestamp",
        F.try_variant_get("source_json", "$.k", "bigint").alias("source_k"),
        "source_text",
    )


@query("usage_event_log", """
select tenant_id, session_id, 'chat_completion' as usage_type, model_name, coalesce(prompt_tokens, 0) as prompt_tokens,
  coalesce(completion_tokens, 0) as completion_tokens, coalesce(total_tokens, 0) as total_tokens, '{"source":"fuzzy"}' as meta_json, created_at
from b_calls
""")
def usage_event_log(b):
    return events.to_usage_events(b.calls, "chat_completion", source="fuzzy")


@query("audit_log_derive", """
select null as actor_id, 'public' as actor_role, tenant_id, 'session_experience_rating_submitted' as action, 'chat_session' as target_type,
  cast(session_id as varchar) as target_id, concat('{"rating":', cast(rating as varchar), '}') as details_json from b_ratings
union all
select cast(user_id as varchar), 'superadmin', tenant_id, 'user_tenant_added', 'user_tenant',
  concat(cast(user_id as varchar), ':', cast(tenant_id as varchar)),
  concat('{"user_id":', cast(user_id as varchar), ',"tenant_id":', cast(tenant_id as varchar), '}') from b_memberships
union all
select null, 'system', tenant_id, 'reindex_triggered', case when tenant_id is null then 'global' else 'tenant' end,
  json_extract_string(meta_json, '$.target_tenant_id'), concat('{"scope":"', scope, '"}') from b_jobs
""")
def audit_log_derive(b):
    rated = events.to_audit(
        b.ratings, "session_experience_rating_submitted", "chat_session", F.col("session_id"), [F.col("rating")]
    )
    joined = events.to_audit(
        b.memberships,
        "user_tenant_added",
        "user_tenant",
        F.concat_ws(":", F.col("user_id").cast("string"), F.col("tenant_id").cast("string")),
        [F.col("user_id"), F.col("tenant_id")],
        actor_id=F.col("user_id"),
        actor_role="superadmin",
    )
    triggered = events.to_audit(
        b.jobs,
        "reindex_triggered",
        F.when(F.col("tenant_id").isNull(), "global").otherwise("tenant"),
        F.get_json_object("meta_json", "$.target_tenant_id"),
        [F.col("scope")],
        actor_role="system",
    )
    return rated.unionByName(joined).unionByName(triggered)


@query("transcript_export", """
select tenant_id, session_id, cast(created_at as date) as day, row_number() over (partition by tenant_id, session_id order by created_at, message_id) as position,
  concat('[', strftime(created_at, '%Y-%m-%dT%H:%M:%S'), '] ', upper(sender_type), ': ', content) as line
from b_messages
""")
def transcript_export(b):
    return transcripts.export_transcripts(b.messages)
