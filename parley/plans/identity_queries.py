"""Queries over visitor identity and merge-style batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import identity, profiles
from parley.plans.registry import query

_KEYED = "(select *, lower(trim(email)) as email_norm from b_visitors where trim(email) <> '')"

MAPPING_SQL = f"""
select v.tenant_id, v.email_norm, v.id as duplicate_id, v.visitor_id as duplicate_visitor_id, c.id as canonical_id,
  c.visitor_id as canonical_visitor_id, c.name as canonical_name, c.email as canonical_email
from {_KEYED} v join (
  select * from (select *, row_number() over (partition by tenant_id, email_norm order by created_at, id) as rn from {_KEYED}) where rn = 1) c
on c.tenant_id = v.tenant_id and c.email_norm = v.email_norm and c.id <> v.id
"""


@query("canonical_visitor", f"""
select tenant_id, email_norm, created_at, id, visitor_id, name, email from (
  select *, row_number() over (partition by tenant_id, email_norm order by created_at, id) as rn from {_KEYED}) where rn = 1
""")
def canonical_visitor(b):
    return identity.canonical_visitors(b.visitors)


@query("latest_profile_by_email", f"""
select tenant_id, email_norm, updated_at, id, visitor_id, name, email from (
  select *, row_number() over (partition by tenant_id, email_norm order by updated_at desc, id desc) as rn from {_KEYED}) where rn = 1
""")
def latest_profile_by_email(b):
    return identity.latest_profiles(b.visitors)


@query("visitor_dedupe", MAPPING_SQL)
def visitor_dedupe(b):
    return identity.dedupe_mapping(b.visitors)


@query("visitor_survivors", f"""
select v.id, v.tenant_id, v.visitor_id, v.name, v.email from b_visitors v where v.id not in (select duplicate_id from ({MAPPING_SQL}))
""")
def visitor_survivors(b):
    kept = identity.surviving_visitors(b.visitors, identity.dedupe_mapping(b.visitors))
    return kept.select("id", "tenant_id", "visitor_id", "name", "email")


@query("repoint_sessions", f"""
select s.session_id, s.tenant_id, coalesce(m.canonical_visitor_id, s.visitor_id) as visitor_id,
  case when m.duplicate_id is not null then m.canonical_name else s.visitor_name end as visitor_name,
  case when m.duplicate_id is not null then m.canonical_email else s.visitor_email end as visitor_email, m.duplicate_id is not null as repointed
from b_sessions s left join ({MAPPING_SQL}) m on m.tenant_id = s.tenant_id and m.duplicate_visitor_id = s.visitor_id
""")
def repoint_sessions(b):
    moved = identity.repoint_sessions(b.sessions, identity.dedupe_mapping(b.visitors))
    return moved.select("session_id", "tenant_id", "visitor_id", "visitor_name", "visitor_email", "repointed")


@query("repoint_ratings", f"""
select r.session_id, r.tenant_id, coalesce(m.canonical_visitor_id, r.visitor_id) as visitor_id, r.rating, m.duplicate_id is not null as repointed
from b_ratings r left join ({MAPPING_SQL}) m on m.tenant_id = r.tenant_id and m.duplicate_visitor_id = r.visitor_id
""")
def repoint_ratings(b):
    moved = identity.repoint_ratings(b.ratings, identity.dedupe_mapping(b.visitors))
    return moved.select("session_id", "tenant_id", "visitor_id", "rating", "repointed")


@query("dedupe_stats", f"""
with m as ({MAPPING_SQL})
select v.tenant_id, count(*) as visitors_scanned,
  (select count(distinct email_norm) from m where m.tenant_id = v.tenant_id) as duplicate_groups,
  (select count(*) from m where m.tenant_id = v.tenant_id) as duplicate_profiles_removed,
  (select count(*) from b_sessions s join m on m.tenant_id = s.tenant_id and m.duplicate_visitor_id = s.visitor_id where s.tenant_id = v.tenant_id) as sessions_repointed,
  (select count(*) from b_ratings r join m on m.tenant_id = r.tenant_id and m.duplicate_visitor_id = r.visitor_id where r.tenant_id = v.tenant_id) as ratings_repointed
from b_visitors v group by v.tenant_id
""")
def dedupe_stats(b):
    return identity.dedupe_stats(b.visitors, identity.dedupe_mapping(b.visitors), b.sessions, b.ratings)


@query("dedupe_preview", f"""
with m as ({MAPPING_SQL}), g as (select tenant_id, email_norm from m group by 1, 2 order by 1, 2 limit 20)
select m.tenant_id, m.email_norm, m.canonical_visitor_id, m.duplicate_visitor_id,
  (select count(*) > 20 from (select distinct tenant_id, email_norm from m)) as preview_truncated
from m join g using (tenant_id, email_norm)
""")
def dedupe_preview(b):
    return identity.dedupe_preview(identity.dedupe_mapping(b.visitors))


RESOLVED_SQL = f"""
with forms as (select *, lower(trim(email)) as email_norm from b_profile_submissions),
latest as (select * from (select *, row_number() over (partition by tenant_id, email_norm order by updated_at desc, id desc) as rn from {_KEYED}) where rn = 1),
j as (
  select f.*, v.id is not null as by_id, l.visitor_id as email_match from forms f
  left join b_visitors v on v.tenant_id = f.tenant_id and v.visitor_id = f.visitor_id
  left join latest l on l.tenant_id = f.tenant_id and l.email_norm = f.email_norm),
firsts as (select tenant_id, email_norm, arg_min(visitor_id, row(submitted_at, seq)) as first_id from j where not by_id group by 1, 2)
select j.seq, j.tenant_id, j.visitor_id, j.name, j.email, j.submitted_at,
  case when by_id then 'by_id' when email_match is not null then 'by_email' else 'insert' end as matched,
  case when by_id then j.visitor_id else coalesce(email_match, first_id) end as resolved_visitor_id
from j left join firsts using (tenant_id, email_norm)
"""


@query("visitor_profile_resolution", RESOLVED_SQL)
def visitor_profile_resolution(b):
    return identity.resolve_profiles(b.visitors, b.profile_submissions)


@query("visitor_profile_merge", f"""
select tenant_id, visitor_id, coalesce(l.name, v.name) as name, coalesce(l.email, v.email) as email,
  coalesce(v.created_at, l.submitted_at) as created_at, coalesce(l.submitted_at, v.updated_at) as updated_at
from b_visitors v full join (
  select tenant_id, resolved_visitor_id as visitor_id, name, email, submitted_at from (
    select *, row_number() over (partition by tenant_id, resolved_visitor_id order by submitted_at desc, seq desc) as rn from ({RESOLVED_SQL})) where rn = 1) l
using (tenant_id, visitor_id)
""")
def visitor_profile_merge(b):
    return identity.merge_profiles(b.visitors, b.profile_submissions)


# one form of every tenant a step; the state is a list of profiles with the place of their last write
_IN_ORDER = """
forms as (select *, trim(visitor_id) as form_id, lower(trim(email)) as email_norm,
  row_number() over (partition by tenant_id order by submitted_at, seq) as o from b_form_stream),
stored as (select tenant_id, visitor_id, lower(trim(email)) as email_norm, row_number() over (partition by tenant_id order by updated_at, id) - 1000000000 as w from b_visitors),
steps as (
  select t.tenant_id, 0::bigint as o, coalesce((select list({'w': w, 'id': visitor_id, 'e': email_norm}) from stored s where s.tenant_id = t.tenant_id), []) as state,
    null::bigint as seq, null::varchar as matched, null::varchar as target
  from (select distinct tenant_id from forms) t
  union all
  select tenant_id, o, list_append(list_filter(state, lambda x: x.id <> target), {'w': o, 'id': target, 'e': email_norm}), seq, matched, target from (
    select *, case when known then 'by_id' when holder is not null then 'by_email' else 'insert' end as matched,
      case when known then form_id else coalesce(holder, form_id) end as target
    from (select f.*, s.state, len(list_filter(s.state, lambda x: x.id = f.form_id)) > 0 as known, list_max(list_filter(s.state, lambda x: x.e = f.email_norm)).id as holder
      from steps s join forms f on f.tenant_id = s.tenant_id and f.o = s.o + 1))),
resolved as (select f.*, s.matched, s.target from forms f join steps s using (tenant_id, o))
"""


@query("visitor_profile_resolution_ordered", f"""
with recursive {_IN_ORDER}
select seq, tenant_id, form_id as visitor_id, name, trim(email) as email, submitted_at, o, matched, target as resolved_visitor_id from resolved
""")
def visitor_profile_resolution_ordered(b):
    return profiles.resolve_in_order(b.visitors, b.form_stream)


@query("visitor_profile_merge_ordered", f"""
with recursive {_IN_ORDER},
l as (select * from (select *, row_number() over (partition by tenant_id, target order by o desc) as rn from resolved) where rn = 1),
i as (select tenant_id, target, max(submitted_at) as begun from resolved where matched = 'insert' group by 1, 2)
select coalesce(v.tenant_id, l.tenant_id) as tenant_id, coalesce(v.visitor_id, l.target) as visitor_id, coalesce(l.name, v.name) as name,
  coalesce(trim(l.email), v.email) as email, coalesce(v.created_at, i.begun) as created_at, coalesce(l.submitted_at, v.updated_at) as updated_at
from b_visitors v full join l on l.tenant_id = v.tenant_id and l.target = v.visitor_id left join i on i.tenant_id = l.tenant_id and i.target = l.target
""")
def visitor_profile_merge_ordered(b):
    return profiles.merge_in_order(b.visitors, b.form_stream)


@query("feedback_merge", """
select message_id, tenant_id, user_id, vote, created_at from (
  select *, row_number() over (partition by message_id, user_id order by created_at desc, src desc) as rn from (
    select *, 0 as src from b_feedback
    union all select message_id, tenant_id, user_id + message_id % 2, case vote when 'up' then 'down' else 'up' end, created_at, 1 from b_feedback))
where rn = 1
""")
def feedback_merge(b):
    flipped = b.feedback.withColumns(
        {
            "user_id": F.col("user_id") + F.col("message_id") % 2,
            "vote": F.when(F.col("vote") == "up", "down").otherwise("up"),
        }
    )
    return identity.merge_feedback(b.feedback, flipped)


@query("session_attach_visitor", """
select s.session_id, s.tenant_id, s.visitor_id, v.name as visitor_name, v.email as visitor_email, v.name || ' (' || v.email || ')' as title
from b_sessions s left join b_visitors v on v.tenant_id = s.tenant_id and v.visitor_id = s.visitor_id
""")
def session_attach_visitor(b):
    attached = identity.attach_visitors(b.sessions, b.visitors)
    return attached.select("session_id", "tenant_id", "visitor_id", "visitor_name", "visitor_email", "title")


@query("rating_first_submission", """
select session_id, tenant_id, seq, trim(visitor_id) as visitor_id, rating, created_at from (
  select p.*, row_number() over (partition by p.session_id order by p.seq) as rn from b_rating_submissions p
  join b_sessions s on s.session_id = p.session_id and s.tenant_id = p.tenant_id
  where p.rating between 1 and 5 and p.session_id not in (select session_id from b_ratings)) where rn = 1
""")
def rating_first_submission(b):
    return identity.first_ratings(b.rating_submissions, b.ratings, b.sessions).select(
        "session_id", "tenant_id", "seq", "visitor_id", "rating", "created_at"
    )


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'tenant')"


@query("unique_slug", f"""
with n as (select c_custkey as id, concat(' ', c_mktsegment, '! Ltd') as name, {_SLUG.format("concat(' ', c_mktsegment, '! Ltd')")} as base from customer),
e as (select case when s_suppkey % 3 = 0 then 'building-ltd' else 'building-ltd-' || cast(2 + s_suppkey * 2 as varchar) end as slug from supplier),
r as (select *, row_number() over (partition by base order by id) as r from n),
c as (select base, i from (select base, count(*) + (select count(*) from e) as top from n group by 1) b, lateral (select unnest(range(1, top + 2)) as i)),
f as (select base, i, slug, row_number() over (partition by base order by i) as r from (
  select base, i, case when i = 1 then base else base || '-' || cast(i as varchar) end as slug from c) where slug not in (select slug from e))
select r.id, r.name, f.slug from r join f using (base, r)
""")
def unique_slug(b):
    names = b.raw("customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("! Ltd")).alias("name")
    )
    key = F.col("s_suppkey")
    existing = b.raw("supplier").select(
        F.when(key % 3 == 0, "building-ltd").otherwise(F.concat(F.lit("building-ltd-"), (2 + key * 2).cast("string"))).alias("slug")
    )
    return identity.unique_slugs(names, existing)
