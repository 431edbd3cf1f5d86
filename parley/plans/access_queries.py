"""Queries over access rules, screening and rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import access, analytics, rules, screening
from parley.plans import sql_parts as sql
from parley.plans.registry import query
from parley.session import shared_dir

# Our own reply texts
PRESET = [
    ("greet", "hi", "Hi, ask me about ${brand_name}.", 10),
    ("greet", "hello", "Hello, ask me about ${brand_name}.", 10),
    ("help", "help", "Tell me what you look for.", 10),
]
DEFAULTS = [(trigger, template) for _, trigger, template, _ in PRESET] + [("thanks", "You are welcome.")]


@query("tenant_scope", """
select u.user_id, u.role, case when u.role = 'superadmin' then (select count(*) from b_messages) else coalesce(s.n, 0) end as visible_rows
from b_users u left join (
  select mb.user_id, count(*) as n from b_memberships mb join b_messages m using (tenant_id) group by 1) s using (user_id)
""")
def tenant_scope(b):
    return access.visible_counts(b.messages, b.users, b.memberships)


@query("tenant_scope_rows", """
select m.message_id, m.tenant_id, m.session_id from b_messages m
where m.tenant_id in (select mb.tenant_id from b_memberships mb where mb.user_id = 3) or exists (select 1 from b_users where user_id = 3 and role = 'superadmin')
""")
def tenant_scope_rows(b):
    return access.scope(b.messages, b.users, b.memberships, 3).select("message_id", "tenant_id", "session_id")


@query("default_tenant", """
select u.user_id, u.role, case when u.role = 'superadmin' then (select tenant_id from b_tenants order by created_at, tenant_id limit 1)
  when exists (select 1 from b_memberships m where m.user_id = u.user_id and m.tenant_id = u.token_tenant_id) then u.token_tenant_id
  else (select m.tenant_id from b_memberships m where m.user_id = u.user_id order by m.ord, m.tenant_id limit 1) end as tenant_id
from b_users u
""")
def default_tenant(b):
    return access.effective_tenant(b.users, b.memberships, b.tenants)


_SEARCH = """
with terms as (select unnest(['ing the', 'CHAT 1', 'user3', 'e_n%o', 'Name 7']) as term)
select distinct t.term, s.tenant_id, s.session_id from terms t join b_sessions s on
  contains(lower(coalesce(s.title, '')), lower(t.term)) or contains(cast(s.session_id as varchar), lower(t.term))
  or contains(lower(coalesce(s.visitor_name, '')), lower(t.term)) or contains(lower(coalesce(s.visitor_email, '')), lower(t.term))
  or exists (select 1 from b_messages m where m.session_id = s.session_id and m.content ilike concat('%', t.term, '%'))
"""


@query("chat_search", _SEARCH)
def chat_search(b):
    from parley.operators.search import search_sessions

    terms = ["ing the", "CHAT 1", "user3", "e_n%o", "Name 7"]
    return search_sessions(b.sessions, b.messages, terms).select("term", "tenant_id", "session_id")


# pieces of user messages, some with wildcards, and names, addresses and short words
TERMS = """
select distinct term from (
  select case message_id % 4 when 0 then lower(substr(content, 3, 12)) when 1 then replace(substr(content, 5, 11), ' ', '_')
    when 2 then replace(substr(content, 2, 14), ' ', '%') else substr(content, 4, 9) end as term from b_messages where sender_type = 'user'
  union all select concat('name ', cast(s_suppkey % 75 as string)) from @{supplier}
  union all select concat('USER', cast(s_suppkey % 75 as string), '@e') from @{supplier}
  union all select substr(n_name, 1, 2) from @{nation}) t
"""


@query("chat_search_terms", f"""
with terms as ({TERMS})
select distinct t.term, s.tenant_id, s.session_id from terms t join b_sessions s on
  contains(lower(coalesce(s.title, '')), lower(t.term)) or contains(cast(s.session_id as varchar), lower(t.term))
  or contains(lower(coalesce(s.visitor_name, '')), lower(t.term)) or contains(lower(coalesce(s.visitor_email, '')), lower(t.term))
union
select distinct t.term, s.tenant_id, s.session_id from terms t join b_messages m on m.content ilike concat('%', t.term, '%')
  join b_sessions s using (session_id)
""")
def chat_search_terms(b):
    from parley.operators.term_index import TermIndex, search_units

    index = TermIndex(b.spark, shared_dir(b.spark, "term-index"))
    index.add(search_units(b.sessions, b.messages), "all")
    return index.search(b.sql(TERMS), beside=b.sessions.select("session_id", "tenant_id")).select("term", "tenant_id", "session_id")


@query("origin_allowed", """
select r.request_id, case when coalesce(t.cors_allowed_origins, '') = '' then true when t.cors_allowed_origins = '*' then true
  else coalesce(list_contains(list_transform(string_split(t.cors_allowed_origins, ','), lambda x: trim(x)), r.origin), false) end as allowed
from b_requests r left join b_tenants t using (tenant_id)
""")
def origin_allowed(b):
    return access.origin_allowed(b.requests, b.tenants).select("request_id", "allowed")


_CLIENT_IP = """
case when regexp_matches(trim(split_part(forwarded_for, ',', 1)), '^[0-9]{1,3}([.][0-9]{1,3}){3}$') then trim(split_part(forwarded_for, ',', 1))
  else regexp_replace(peer, '^2001:0DB([0-9]):0:0:0:0:0:', '2001:db\\1::') end
"""


@query("client_ip_extract", f"select request_id, {_CLIENT_IP} as client_ip from b_requests")
def client_ip_extract(b):
    return screening.with_client_ip(b.requests).select("request_id", "client_ip")


_CONFIG = f"""
select tenant_id, 'tenant' as kind, 'widget_primary_color' as field, widget_primary_color as value, 'hex_color' as rule from b_tenants
  where not regexp_matches({sql.filled('widget_primary_color')}, '^#([0-9a-fA-F]{{3}}|[0-9a-fA-F]{{6}})$')
union all select tenant_id, 'tenant', 'widget_website_url', widget_website_url, 'http_url' from b_tenants
  where not regexp_matches({sql.filled('widget_website_url')}, '^https?://')
union all select tenant_id, 'tenant', 'widget_source_type', widget_source_type, 'source_type_form' from b_tenants
  where not regexp_matches({sql.filled('widget_source_type')}, '^[a-zA-Z0-9_.-]{{1,64}}$')
union all select tenant_id, 'tenant', 'idle_rating_wait_seconds', cast(idle_rating_wait_seconds as varchar), 'at_least_5' from b_tenants where idle_rating_wait_seconds < 5
union all select tenant_id, 'tenant', 'monthly_message_limit', cast(monthly_message_limit as varchar), 'positive' from b_tenants where monthly_message_limit < 1
union all select tenant_id, 'quick_reply', 'similarity_threshold', cast(priority * 11 as varchar), 'between_50_100' from b_quick_replies where priority * 11 not between 50 and 100
union all select tenant_id, 'block_rule', 'match_mode', word, 'known_match_mode' from b_block_rules where lower(word) not in ('exact', 'substring', 'regex')
union all select tenant_id, 'blocked_ip', 'ip_address', ip, 'ip_address' from (
  select tenant_id, replace(ip_address, '.1', '.x1') as ip from b_blocked_ips) where contains(ip, 'x')
union all select tenant_id, 'blocked_country', 'country_code', code, 'two_letters' from (
  select tenant_id, case when country_code = 'CC' then 'C1' else country_code end as code from b_blocked_countries) where code = 'C1'
"""


@query("tenant_config_quality", _CONFIG)
def tenant_config_quality(b):
    broken = F.when(F.col("country_code") == "CC", "C1").otherwise(F.col("country_code"))
    return screening.validate_config(
        b.tenants,
        b.quick_replies.withColumn("similarity_threshold", F.col("priority") * 11),
        b.block_rules.withColumn("match_mode", F.col("word")),
        b.blocked_ips.withColumn("ip_address", F.replace("ip_address", F.lit(".1"), F.lit(".x1"))),
        b.blocked_countries.withColumn("country_code", broken),
    )


@query("visitor_id_validate", """
select c_custkey, trim(raw) as visitor_id from (select c_custkey, concat('  ', repeat('v', c_custkey % 80), ' ') as raw from customer)
where length(trim(raw)) between 1 and 64
""")
def visitor_id_validate(b):
    raw = F.concat(F.lit("  "), F.repeat(F.lit("v"), (F.col("c_custkey") % 80).cast("int")), F.lit(" "))
    rows = b.raw("customer").select("c_custkey", text.valid_visitor_id(raw).alias("visitor_id"))
    return rows.where(F.col("visitor_id").isNotNull())


@query("email_normalize", "select id, lower(trim(coalesce(email, ''))) as email from b_visitors")
def email_normalize(b):
    return b.visitors.select("id", text.norm_email(F.col("email")).alias("email"))


@query("asset_url_normalize", f"""
select tenant_id, case when instr({sql.filled('avatar_url')}, '/api/assets/') > 0 then substr({sql.filled('avatar_url')}, instr({sql.filled('avatar_url')}, '/api/assets/'))
  else {sql.filled('avatar_url')} end as avatar_url from b_tenants
""")
def asset_url_normalize(b):
    return b.tenants.select("tenant_id", text.asset_path(F.col("avatar_url")).alias("avatar_url"))


@query("brand_label", f"select tenant_id, {sql.brand('brand_name', 'name')} as brand_label from b_tenants")
def brand_label(b):
    return b.tenants.select("tenant_id", text.brand_label(F.col("brand_name"), F.col("name")).alias("brand_label"))


@query("membership_detail", """
select m.user_id, m.tenant_id, m.ord, t.name as tenant_name from b_memberships m left join b_tenants t using (tenant_id)
""")
def membership_detail(b):
    return access.membership_detail(b.memberships, b.tenants)


@query("tenant_users", """
select m.tenant_id, u.user_id, u.email, u.role, u.is_active, u.created_at from b_memberships m join b_users u using (user_id) where u.role <> 'superadmin'
""")
def tenant_users(b):
    return access.tenant_users(b.users, b.memberships)


@query("tenant_actor", """
select tenant_id, arg_min(user_id, row(ord, user_id)) as actor_user_id from b_memberships join b_users using (user_id) where is_active group by 1
""")
def tenant_actor(b):
    return access.tenant_actor(b.memberships, b.users)


@query("reindex_job_listing", """
select j.job_id, j.tenant_id, json_extract_string(j.meta_json, '$.target_tenant_id') as target_tenant_id, j.scope, j.status, j.created_at, t.name as tenant_name
from b_jobs j left join b_tenants t
  on cast(t.tenant_id as varchar) = coalesce(cast(j.tenant_id as varchar), json_extract_string(j.meta_json, '$.target_tenant_id'))
""")
def reindex_job_listing(b):
    return access.job_listing(b.jobs, b.tenants).select(
        "job_id", "tenant_id", "target_tenant_id", "scope", "status", "created_at", "tenant_name"
    )


@query("ip_block_screen", f"""
select r.request_id, r.client_ip, i.ip_address is not null as ip_blocked from (select *, {_CLIENT_IP} as client_ip from b_requests) r
left join b_blocked_ips i on i.tenant_id = r.tenant_id and i.ip_address = r.client_ip
""")
def ip_block_screen(b):
    return screening.ip_screen(screening.with_client_ip(b.requests), b.blocked_ips).select("request_id", "client_ip", "ip_blocked")


_IP_NUMBER = """case when not contains(client_ip, ':') then
  list_reduce(list_transform(string_split(client_ip, '.'), lambda x: cast(x as bigint)), lambda a, x: a * 256 + x) end"""
_IP6_KEY = """case when contains(client_ip, ':') then
  concat('20010db', substr(client_ip, 8, 1), repeat('0', 20), lpad(split_part(client_ip, '::', 2), 4, '0')) end"""


@query("country_block_screen", f"""
select r.request_id, g.country_code, c.tenant_id is not null as country_blocked
from (select *, {_IP_NUMBER} as n, {_IP6_KEY} as k from (select *, {_CLIENT_IP} as client_ip from b_requests)) r
left join b_geo_ranges g on r.n between g.ip_start and g.ip_end or r.k between g.ip6_start and g.ip6_end
left join b_blocked_countries c on c.tenant_id = r.tenant_id and c.country_code = g.country_code
""")
def country_block_screen(b):
    screened = screening.country_screen(screening.with_client_ip(b.requests), b.geo_ranges, b.blocked_countries)
    return screened.select("request_id", "country_code", "country_blocked")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


@query("seed_missing_quick_replies", f"""
select t.tenant_id, p.category, p.trigger_phrase, p.response_template, p.priority, p.ord, cast(null as int) as similarity_threshold, true as enabled
from b_tenants t cross join (values {_values([(*r, i) for i, r in enumerate(PRESET, 1)])}) p(category, trigger_phrase, response_template, priority, ord)
where not exists (select 1 from b_quick_replies q where q.tenant_id = t.tenant_id)
""")
def seed_missing_quick_replies(b):
    return rules.seed_replies(b.tenants, b.quick_replies, PRESET)


MERGED_SQL = f"""
select tenant_id, lower(trim(trigger_phrase)) as trigger_phrase, response_template, similarity_threshold, priority, ord, false as is_default from b_quick_replies where enabled
union all
select t.tenant_id, d.trigger_phrase, d.response_template, null, 0, d.ord, true
from b_tenants t cross join (values {_values([(*r, i) for i, r in enumerate(DEFAULTS, 1)])}) d(trigger_phrase, response_template, ord)
where not exists (select 1 from b_quick_replies q where q.enabled and q.tenant_id = t.tenant_id and lower(trim(q.trigger_phrase)) = d.trigger_phrase)
"""


@query("merge_rules_with_defaults", MERGED_SQL)
def merge_rules_with_defaults(b):
    return rules.merge_rules(b.quick_replies, DEFAULTS, b.tenants)


@query("rule_listing_order", """
select tenant_id, category, priority, trigger_phrase, enabled from b_quick_replies order by tenant_id, category, priority desc, trigger_phrase
""")
def rule_listing_order(b):
    return rules.order_rules(b.quick_replies).select("tenant_id", "category", "priority", "trigger_phrase", "enabled")


@query("category_words_nested", """
select tenant_id, category_ord, category, row_number() over (partition by tenant_id, category_ord, category order by word_ord) as position, word
from b_block_rules
""")
def category_words_nested(b):
    return rules.nest_words(b.block_rules, ["tenant_id", "category_ord", "category"])


@query("membership_reconcile", """
with sets as (select user_id, count(*) as n, count(*) filter (where tenant_id not in (select tenant_id from b_tenants)) as missing from b_target_memberships group by 1),
judged as (
  select u.user_id, u.role, case when u.role = 'manager' and coalesce(n, 0) <> 1 then 'manager needs exactly one tenant'
    when u.role = 'admin' and coalesce(n, 0) < 1 then 'admin needs at least one tenant'
    when u.role = 'superadmin' and coalesce(n, 0) > 0 then 'superadmin is managed by role'
    when missing > 0 then 'unknown tenant' end as reason from b_users u left join sets using (user_id)),
passed as (select user_id from judged where reason is null and role <> 'superadmin'),
cur as (select user_id, tenant_id from b_memberships where user_id in (select * from passed)),
tgt as (select user_id, tenant_id from b_target_memberships where user_id in (select * from passed))
select user_id, tenant_id, 'add' as action, null as reason from (select * from tgt except select * from cur)
union all select user_id, tenant_id, 'remove', null from (select * from cur except select * from tgt)
union all select user_id, null, 'refuse', reason from judged where reason is not null
""")
def membership_reconcile(b):
    return access.reconcile_memberships(b.memberships, b.target_memberships, b.users, b.tenants)
