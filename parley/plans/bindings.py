"""Input tables of the operators, derived from the supplied parquet tables.

One SQL text per view serves both engines: ``@{name}`` is a supplied table
and ``@{ts}`` the engine's constructor of a timestamp without zone.  Every view reads
whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    # tenants: blank brands, suspended rows, missing and empty source DSNs, unset limits
    "b_tenants": """
select s_suppkey as tenant_id, s_name as name, s_nationkey as nation_id,
  case when s_suppkey % 5 = 0 then '' else concat('Brand ', s_name) end as brand_name,
  case when s_suppkey % 6 = 5 then 'suspended' else 'active' end as status,
  case when s_suppkey % 4 = 0 then null when s_suppkey % 4 = 1 then ''
    else concat('mysql://u', cast(s_suppkey as string), ':p%40w@db', cast(s_suppkey as string), '.example.com',
      case when s_suppkey % 3 = 0 then ':3307' else '' end, '/cms') end as source_db_url,
  case when s_suppkey % 3 = 0 then null else 'site_' end as source_table_prefix,
  'url_list' as source_url_table,
  case when s_suppkey % 9 = 0 then '  ' when s_suppkey % 9 = 1 then null else concat('Helper ', s_name) end as widget_header_title,
  case when s_suppkey % 8 = 0 then null when s_suppkey % 8 = 1 then concat('ftp://t', cast(s_suppkey as string), '.example.com')
    else concat(' https://t', cast(s_suppkey as string), '.example.com ') end as widget_website_url,
  case when s_suppkey % 4 = 0 then '' when s_suppkey % 4 = 1 then 'bad type!' else 'primary' end as widget_source_type,
  case when s_suppkey % 7 = 0 then 'red' when s_suppkey % 7 = 1 then '#0aF' else '#12ab9F' end as widget_primary_color,
  case when s_suppkey % 6 = 0 then concat('https://cdn.example.com/api/assets/a', cast(s_suppkey as string), '.png')
    when s_suppkey % 6 = 1 then '  ' when s_suppkey % 6 = 2 then null else concat(' /img/', cast(s_suppkey as string), '.png ') end as avatar_url,
  cast(case when s_suppkey % 3 = 0 then 0 else 1 + s_suppkey % 7 end as int) as monthly_message_limit,
  cast(case when s_suppkey % 2 = 0 then 120 else 3 end as int) as idle_rating_wait_seconds,
  case when s_suppkey % 7 = 0 then '*' when s_suppkey % 7 = 1 then null else ' https://a.example.com , https://b.example.com' end as cors_allowed_origins,
  @{ts}(2023, cast(1 + s_suppkey % 12 as int), cast(1 + s_suppkey % 28 as int), 0, 0, 0) as created_at
from @{supplier}""",
    "b_messages": """
select conv_id * 1000 + turn as message_id, conv_id as session_id, conv_id % 25 as tenant_id, role as sender_type, text as content,
  case when role = 'assistant' and turn % 4 = 1 then concat('{"total_tokens":', cast(length(text) as string), '}') else null end as token_usage_json,
  @{ts}(2024, cast(1 + conv_id % 3 as int), cast(1 + conv_id % 28 as int), cast(turn % 24 as int), cast(conv_id % 60 as int), 0) as created_at
from @{conversations}""",
    "b_sessions": """
select session_id, tenant_id, min(created_at) as started_at, max(created_at) as last_message_at, count(*) as n_messages,
  case when session_id % 7 = 0 then null else concat('v', cast(session_id % 75 as string)) end as visitor_id,
  case when session_id % 5 = 0 then '' else concat('Name ', cast(session_id % 75 as string)) end as visitor_name,
  case when session_id % 6 = 0 then null else concat('user', cast(session_id % 75 as string), '@Example.com') end as visitor_email,
  concat('Chat ', cast(session_id as string)) as title
from b_messages group by session_id, tenant_id""",
    "b_feedback": """
select message_id, tenant_id, session_id % 5 as user_id,
  case when message_id % 3 = 0 then 'down' else 'up' end as vote, created_at
from b_messages where sender_type = 'assistant'""",
    # longer chats of known visitors carry a rating
    "b_ratings": """
select session_id, tenant_id, visitor_id, cast(1 + session_id % 5 as int) as rating, last_message_at as created_at
from b_sessions where visitor_id is not null and n_messages > 4""",
    "b_rating_submissions": """
select message_id as seq, session_id, case when message_id % 11 = 0 then tenant_id + 1 else tenant_id end as tenant_id,
  concat(' v', cast(session_id % 75 as string)) as visitor_id, cast(message_id % 7 as int) as rating, created_at
from b_messages where sender_type = 'user'""",
    "b_usage": """
select event_id as usage_id, user_id % 25 as tenant_id,
  case when event_type = 'purchase' then null else user_id end as session_id,
  case event_type when 'click' then 'chat_completion' when 'view' then 'chat_embedding' when 'purchase' then 'index_embedding' else event_type end as usage_type,
  cast(floor(value) as bigint) as prompt_tokens, cast(floor(value / 2) as bigint) as completion_tokens,
  cast(floor(value) as bigint) + cast(floor(value / 2) as bigint) as total_tokens, props as meta_json, ts as created_at
from @{events}""",
    # model calls before they become usage rows; token fields may be missing
    "b_calls": """
select event_id as call_id, user_id % 25 as tenant_id, user_id as session_id, concat('model-', event_type) as model_name,
  case when event_type = 'error' then null else cast(floor(value) as bigint) end as prompt_tokens,
  case when event_type in ('view', 'purchase') then null else cast(floor(value / 2) as bigint) end as completion_tokens,
  case when event_type = 'error' then null else cast(floor(value) as bigint) end as total_tokens, ts as created_at
from @{events}""",
    "b_visitors": """
select c_custkey as id, c_custkey % 25 as tenant_id, concat('v', cast(c_custkey as string)) as visitor_id, c_name as name,
  case when c_custkey % 11 = 0 then ' '
    else concat(case when c_custkey % 2 = 0 then ' User' else 'user' end, cast(c_custkey % 50 as string), '@Example.com') end as email,
  @{ts}(2024, cast(1 + c_custkey % 3 as int), cast(1 + c_custkey % 28 as int), cast(c_custkey % 24 as int), cast(c_custkey % 60 as int), 0) as created_at,
  @{ts}(2024, 4, cast(1 + c_custkey % 27 as int), cast(c_custkey % 23 as int), cast(c_custkey % 59 as int), 0) as updated_at
from @{customer}""",
    "b_users": """
select s_suppkey as user_id, concat('staff', cast(s_suppkey as string), '@example.com') as email,
  case when s_suppkey % 10 = 0 then 'superadmin' when s_suppkey % 3 = 0 then 'manager' else 'admin' end as role,
  s_suppkey % 7 <> 0 as is_active,
  case when s_suppkey % 4 = 0 then s_suppkey % 25 else null end as token_tenant_id,
  @{ts}(2024, 1, cast(1 + s_suppkey % 28 as int), 0, 0, 0) as created_at
from @{supplier}""",
    # managers belong to one tenant, other staff to up to two
    "b_memberships": """
select user_id, tenant_id, min(ord) as ord from (
  select user_id, user_id % 25 as tenant_id, 0 as ord from b_users
  union all select user_id, (user_id * 7 + 3) % 25, 1 from b_users where role <> 'manager') m
group by user_id, tenant_id""",
    # requested memberships: kept, moved and surplus rows; overdrawn suppliers ask for none
    "b_target_memberships": """
select distinct user_id, tenant_id from (
  select s_suppkey as user_id, s_suppkey % 25 as tenant_id from @{supplier} where s_acctbal >= 0
  union all select s_suppkey, (s_suppkey * 11 + 5) % 25 from @{supplier} where s_acctbal > 5000) t""",
    "b_urls": """
select page_id as id, page_id % 25 as tenant_id, case page_id % 6
  when 0 then url when 1 then concat('@@', url)
  when 2 then concat('HTTPS://h', cast(page_id % 9 as string), '.example.com/?p=', cast(page_id as string))
  when 3 then concat('https://h', cast(page_id % 9 as string), '.example.com/a/field_6846a4e998b8')
  when 4 then concat('www.h', cast(page_id % 9 as string), '.example.com/x') else '' end as url
from @{pages}""",
    # CMS option rows; some sites never set their URL
    "b_options": """
select c_custkey as option_id, c_custkey % 29 as tenant_id,
  case when c_custkey % 29 > 20 then 'home' when c_custkey % 3 = 0 then 'blogname' else 'siteurl' end as option_name,
  concat('https://site', cast(c_custkey % 29 as string), '.example.com', case when c_custkey % 2 = 0 then '/' else '' end) as option_value
from @{customer}""",
    "b_posts": """
select doc_id as id, doc_id % 25 as tenant_id, concat('Doc ', cast(doc_id as string)) as title,
  case when doc_id % 13 = 0 then '' else concat('<p class="x">', text, '&nbsp;&amp; <b>end</b></p>') end as content,
  case when doc_id % 4 = 0 then 'page' else 'post' end as type,
  case when doc_id % 5 = 0 then 'draft' else 'publish' end as status,
  case doc_id % 7 when 0 then '' when 1 then 'field_6846a4e998b80' when 2 then concat('/a/doc-', cast(doc_id as string), '/')
    else concat('doc-', cast(doc_id as string)) end as post_name,
  @{ts}(2024, cast(1 + doc_id % 12 as int), cast(1 + doc_id % 28 as int), 0, 0, 0) as post_date
from @{documents}""",
    # vector collection: one point per document; ids repeat over tenants, types are the tenant's own or external
    "b_vectors": """
select cast((d.doc_id - d.doc_id % 25) / 25 as bigint) as vec_id, d.doc_id % 25 as tenant_id,
  case when e.label % 2 = 0 then coalesce(nullif(trim(t.widget_source_type), ''), 'primary') else 'external' end as source_type,
  e.embedding, d.text as content, d.source,
  case when d.doc_id % 9 = 0 then 'not a url' when d.doc_id % 9 = 1 then '' else concat('https://', d.source, '.example.com/d/', cast(d.doc_id as string)) end as url
from (select *, doc_id % (select count(*) from @{embeddings}) as e_id from @{documents}) d
join @{embeddings} e on e.vec_id = d.e_id left join b_tenants t on t.tenant_id = d.doc_id % 25""",
    # one query vector per user message
    "b_query_vectors": """
select m.message_id as query_id, m.tenant_id, m.content as question, e.embedding as qe
from (select *, (session_id * 8 + message_id) % (select count(*) from @{embeddings}) as e_id from b_messages where sender_type = 'user') m
join @{embeddings} e on e.vec_id = m.e_id""",
    "b_requests": """
select event_id as request_id, user_id % 25 as tenant_id,
  case event_id % 4 when 0 then '' when 1 then 'unknown, 10.0.0.1'
    else concat(' 10.', cast(user_id % 4 as string), '.', cast(event_id % 256 as string), '.', cast(user_id % 256 as string), ' , 172.16.0.1') end as forwarded_for,
  case when event_id % 4 = 0 and event_id % 3 = 0 then concat('2001:0DB', cast(user_id % 10 as string), ':0:0:0:0:0:', cast(1 + event_id % 256 as string))
    else concat('192.168.', cast(user_id % 8 as string), '.', cast(event_id % 256 as string)) end as peer,
  case event_id % 3 when 0 then null when 1 then 'https://a.example.com' else 'https://c.example.com' end as origin, ts
from @{events}""",
    # IPv4 ranges as numbers, IPv6 ranges as 32 hex digits
    "b_geo_ranges": """
select * from (values (cast(167772160 as bigint), cast(167837695 as bigint), cast(null as string), cast(null as string), 'AA'), (167837696, 167903231, null, null, 'BB'),
  (167903232, 168001535, null, null, 'CC'), (3232235520, 3232301055, null, null, 'DD'),
  (null, null, '20010db0000000000000000000000000', '20010db4ffffffffffffffffffffffff', 'BB'),
  (null, null, '20010db6000000000000000000000000', '20010db60000000000000000000000ff', 'CC')) t(ip_start, ip_end, ip6_start, ip6_end, country_code)""",
    "b_blocked_ips": """
select distinct user_id % 25 as tenant_id, concat('192.168.', cast(user_id % 8 as string), '.', cast(event_id % 256 as string)) as ip_address
from @{events} where event_type = 'error'
union select distinct user_id % 25, concat('2001:db', cast(user_id % 10 as string), '::', cast(1 + event_id % 256 as string))
from @{events} where event_type = 'click' and event_id % 4 = 0""",
    "b_blocked_countries": """
select tenant_id, case when nation_id % 2 = 0 then 'BB' else 'CC' end as country_code from b_tenants
union all select tenant_id, 'DD' from b_tenants where status = 'suspended'""",
    # every user message with its own text, and beside each a short one with an id of its own
    "b_short_messages": """
select message_id, session_id, tenant_id, created_at, content from b_messages where sender_type = 'user'
union all select -1 - message_id, session_id, tenant_id, created_at,
  case message_id % 7 when 0 then '  Hello ' when 1 then 'helo' when 2 then 'thank  you' when 3 then 'Thanks!'
    when 4 then 'forbidden topic' when 5 then 'order no. 4711 please' else 'please stop-now at once' end
from b_messages where sender_type = 'user'""",
    # tenant reply rules: some tenants have none, one rule is off, one has its own threshold
    "b_quick_replies": """
select tenant_id, @{rows:replies} from b_tenants where nation_id < 18""",
    # block rules: one regex is invalid on purpose
    "b_block_rules": """
select tenant_id, @{rows:blocks} from b_tenants where nation_id > 6""",
    "b_jobs": """
select event_id as job_id, case when event_id % 3 = 0 then null else user_id % 25 end as tenant_id,
  case when event_id % 3 = 0 then 'all' else 'tenant' end as scope,
  case event_id % 4 when 0 then 'running' when 1 then 'failed' else 'completed' end as status,
  concat('{"target_tenant_id":"', cast(user_id % 127 as string), '"}') as meta_json, ts as created_at
from @{events}""",
    # per-document outcome of an ingest run, for summaries and progress
    "b_ingest_status": """
select doc_id, doc_id % 25 as tenant_id, concat('run-', lang) as run_id,
  case when n_chars % 10 = 0 then 'failed' else 'succeeded' end as status
from @{documents}""",
    # profile forms: known id, new id with a known e-mail, all new
    "b_profile_submissions": """
select c_custkey as seq, c_custkey % 25 as tenant_id,
  case when c_custkey % 3 = 0 then concat('v', cast(c_custkey as string)) else concat('n', cast(c_custkey as string)) end as visitor_id,
  concat('New ', c_name) as name,
  case when c_custkey % 3 = 1 then concat('USER', cast(c_custkey % 50 as string), '@example.com') else concat('fresh', cast(c_custkey as string), '@example.com') end as email,
  @{ts}(2024, 5, cast(1 + c_custkey % 28 as int), cast(c_custkey % 24 as int), 0, 0) as submitted_at
from @{customer}""",
    # forms whose outcome depends on earlier ones: ids and e-mails come again
    "b_form_stream": """
select c_custkey as seq, c_custkey % 25 as tenant_id,
  case c_custkey % 4 when 0 then concat('v', cast(c_custkey as string)) when 1 then concat('n', cast(c_custkey % 100 as string))
    when 2 then concat(' n', cast(c_custkey % 300 as string), ' ') else concat('m', cast(c_custkey as string)) end as visitor_id,
  concat('New ', c_name) as name,
  case when c_custkey % 3 = 0 then concat('USER', cast(c_custkey % 50 as string), '@example.com')
    else concat('fresh', cast(c_custkey * 7 % 40 as string), '@example.com') end as email,
  @{ts}(2024, 5, cast(1 + c_custkey * 11 % 28 as int), cast(c_custkey % 24 as int), 0, 0) as submitted_at
from @{customer}""",
    # older event store: sparse rows, JSON or plain text in the source column
    "b_chat_events": """
select event_id, user_id as session_no, event_type, ts as event_timestamp,
  case when event_type in ('click', 'view') then concat('text ', cast(event_id as string)) else null end as user_message_text,
  case when event_id % 5 = 0 then 'plain note' when event_id % 5 = 1 then null else props end as bot_response_source,
  case when event_type = 'view' then value / 1000 else null end as bot_response_confidence
from @{events}""",
}

#: Rule rows repeated for each tenant of a view: column names, then values as SQL text.
ROWS: dict[str, tuple[list[str], list[list[str]]]] = {
    "replies": (
        ["category", "trigger_phrase", "response_template", "similarity_threshold", "priority", "enabled", "ord"],
        [
            ["'greet'", "'hello'", "concat('Welcome to $', '{brand_name}.')", "cast(null as int)", "10", "true", "1"],
            ["'thanks'", "'thank you'", "concat('Any time. See $', '{website_url}')", "95", "5", "true", "2"],
            ["'thanks'", "'thanks'", "concat('Glad to help, says $', '{assistant_name}.')", "cast(null as int)", "5", "false", "3"],
        ],
    ),
    "blocks": (
        ["category_ord", "category", "match_mode", "word_ord", "word", "response_message"],
        [
            ["1", "'topics'", "'exact'", "1", "'Forbidden Topic'", "'This topic is closed.'"],
            ["2", "'phrases'", "'substring'", "1", "'STOP-NOW'", "'Request noted.'"],
            ["3", "'patterns'", "'regex'", "1", "'('", "'never'"],
            ["3", "'patterns'", "'regex'", "2", "'no[.] [0-9]{4}'", "'Numbers are not accepted.'"],
        ],
    ),
}


def _spark_rows(name: str) -> str:
    """The rows exploded beside each tenant: one scan, no join."""
    columns, rows = ROWS[name]
    structs = ["named_struct(" + ", ".join(f"'{c}', {v}" for c, v in zip(columns, row)) + ")" for row in rows]
    return f"inline(array({', '.join(structs)}))"


def _duckdb_rows(name: str) -> str:
    columns, rows = ROWS[name]
    structs = ["{" + ", ".join(f"'{c}': {v}" for c, v in zip(columns, row)) + "}" for row in rows]
    return f"unnest([{', '.join(structs)}], recursive := true)"


_TOKEN = re.compile(r"@\{([\w:]+)\}")
_VIEW_NAME = re.compile(r"\bb_[a-z_]+\b")


def _deps(text: str) -> list[str]:
    """Views a text needs, dependencies first."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in _VIEW_NAME.findall(sql):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(text)
    return order


def _with_views(text: str, resolve) -> str:
    ctes = [f"{name} as ({VIEWS[name].strip()})" for name in _deps(text)]
    text = text.strip()
    if ctes:
        joined = ",\n".join(ctes)
        start = next((s for s in ("with recursive ", "with ") if text.lower().startswith(s)), None)
        text = f"{start}{joined},\n{text[len(start):]}" if start else f"with {joined}\n{text}"
    return _TOKEN.sub(resolve, text)


def duckdb_sql(text: str) -> str:
    """Self-contained DuckDB text for a query over the views."""

    def resolve(match: re.Match) -> str:
        name = match.group(1)
        if name.startswith("rows:"):
            return _duckdb_rows(name[5:])
        return "make_timestamp" if name == "ts" else name

    return _with_views(text, resolve)


_SCHEMAS: dict[str, object] = {}


class Bindings:
    """Lazy access to the views (``b.messages``) and supplied tables (``b.raw("pages")``) of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, table: str) -> DataFrame:
        """A supplied table; its schema is read from the files once per process."""
        path = f"{self.sf_dir}/{table}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def sql(self, text: str) -> DataFrame:
        """A query over the views; each call scans tables of its own, so results can be joined freely."""

        def resolve(match: re.Match) -> str:
            name = match.group(1)
            if name == "ts":
                return "make_timestamp_ntz"
            if name.startswith("rows:"):
                return _spark_rows(name[5:])
            tables.add(name)
            return f"parley_{name}"

        tables: set[str] = set()
        full = _with_views(text, resolve)
        for name in tables:
            self.raw(name).createOrReplaceTempView(f"parley_{name}")
        return self.spark.sql(full)

    def __getattr__(self, name: str) -> DataFrame:
        if f"b_{name}" not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"select * from b_{name}")
