"""Queries over retrieval, context building, routing and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import ingest, rules
from parley.operators import retrieval as rt
from parley.operators.vector_index import HyperplaneIndex, recall
from parley.plans import cascade
from parley.plans import sql_parts as sql
from parley.plans.access_queries import DEFAULTS
from parley.plans.document_queries import EXTERNAL_SQL, POSTS_SQL, SITE_DEFAULT
from parley.plans.matching_queries import BLOCKED_SQL
from parley.plans.registry import _ORACLES, query
from parley.session import shared_dir
from parley.sources import cms, vectors

_DOUBLES = "list_transform({}, lambda x: cast(x as double))"
_SCORED = f"""
select q.query_id, q.tenant_id, v.source_type, v.vec_id, v.source_type = coalesce(own.source_type, 'primary') as own,
  list_cosine_similarity({_DOUBLES.format('q.qe')}, {_DOUBLES.format('v.embedding')}) as score
from b_query_vectors q join b_vectors v on v.tenant_id = q.tenant_id left join ({sql.TAGS}) own on own.tenant_id = q.tenant_id
"""
_BUCKETS = f"""
select query_id, tenant_id, source_type, vec_id, own, score, rank from (
  select *, row_number() over (partition by query_id, source_type order by score desc, vec_id) as rank from ({_SCORED}))
where rank <= 3 and (own or source_type = 'external')
"""
_TWO = f"""
select query_id, tenant_id, source_type, vec_id, score, position from (
  select *, row_number() over (partition by query_id order by score desc, own desc, rank) as position from (
    select *, count(*) filter (where own) over (partition by query_id) as n,
      coalesce(max(case when own then score end) over (partition by query_id), 0) as best from ({_BUCKETS}))
  where own or n < 3 or best < 0.7)
where position <= 3
"""
_FILTERED = f"select * from ({_TWO}) where score >= 0.3"
_CITED = f"""
select * from (
  select h.query_id, h.tenant_id, h.position, h.source_type, h.vec_id, h.score, v.source, v.content, concat(left(v.content, 200), '...') as snippet,
    coalesce(nullif({sql.fixed('v.url', "coalesce(tags.fallback_url, '')")}, ''), nullif({sql.root('v.url', '/')}, '')) as url
  from ({_FILTERED}) h join b_vectors v using (tenant_id, source_type, vec_id) left join ({sql.TAGS}) tags on tags.tenant_id = h.tenant_id)
where url is not null
"""
_CONTEXTS = f"select query_id, position, concat('Source: ', source, chr(10), 'URL: ', url, chr(10), content) as context from ({_CITED})"


def _cut(c: str, n: str) -> str:
    head = f"cast(floor(({n}) * 0.8) as int)"
    return (
        f"case when length({c}) <= ({n}) then {c} else concat(left({c}, {head}), chr(10), '...[content truncated]...', chr(10), "
        f"right({c}, ({n}) - {head})) end"
    )


_PACKED = f"""
select query_id, string_agg(case when total > 14000 then {_cut('context', 'greatest(cast(floor(share * (14000.0::double / total)) as int), 500)')} else cut end,
  concat(chr(10), chr(10), '---', chr(10), chr(10)) order by position) as context, count(*) as n_hits
from (
  select *, sum(length(cut)) over (partition by query_id) as total from (
    select *, {_cut('context', 'share')} as cut from (
      select *, cast(floor(14000 / count(*) over (partition by query_id)) as int) as share from ({_CONTEXTS}))))
group by 1
"""


def _shown(columns: str) -> str:
    """Columns of a result; scores are compared in full and shown at six decimals."""
    return columns.replace("score", "round(score, 6) as score")


def _rounded(df, *columns):
    return df.withColumn("score", F.round("score", 6)).select(*columns)


_HIT = ["query_id", "tenant_id", "source_type", "vec_id", "score"]


@query("vector_topk", f"""
select {_shown('query_id, tenant_id, source_type, vec_id, score, rank')} from (
  select *, row_number() over (partition by query_id order by score desc, source_type, vec_id) as rank from ({_SCORED}))
where rank <= 5
""")
def vector_topk(b):
    return _rounded(rt.topk(b.query_vectors, b.vectors, k=5), *_HIT, "rank")


#: The supplied vectors have no near neighbours (the fifth best is at a cosine of about 0.3), so small cells need many tries.
APPROXIMATE = HyperplaneIndex(tables=4, cell_rows=32, crossed=2)


@query("vector_topk_approx", None)
def vector_topk_approx(b):
    return _rounded(APPROXIMATE.topk(b.query_vectors, APPROXIMATE.build(b.vectors), k=5), *_HIT, "rank")


@query("vector_topk_recall", f"""
select count(*) as wanted, true as reached from (
  select row_number() over (partition by query_id, source_type order by score desc, vec_id) as rank from ({_SCORED}))
where rank <= 5
""")
def vector_topk_recall(b):
    found = APPROXIMATE.topk(b.query_vectors, APPROXIMATE.build(b.vectors), k=5)
    measured = recall(found, rt.bucket_topk(b.query_vectors, b.vectors, k=5))
    return measured.select("wanted", (F.col("recall") >= 0.9).alias("reached"))


def _tags(b):
    return cms.payload_tags(b.tenants)


@query("two_bucket_search", f"select {_shown('query_id, tenant_id, source_type, vec_id, score, position')} from ({_TWO})")
def two_bucket_search(b):
    return _rounded(rt.two_bucket(b.query_vectors, b.vectors, sources=_tags(b)), *_HIT, "position")


@query("bucket_union_rerank", f"""
select {_shown('query_id, tenant_id, source_type, vec_id, score, position')} from (
  select *, row_number() over (partition by query_id order by score desc, own desc, rank) as position from ({_BUCKETS}))
where position <= 3
""")
def bucket_union_rerank(b):
    return _rounded(rt.union_rerank(b.query_vectors, b.vectors, sources=_tags(b)), *_HIT, "position")


def _filtered(b):
    return rt.min_score(rt.two_bucket(b.query_vectors, b.vectors, sources=_tags(b)))


def _cited(b):
    hits = rt.with_payload(_filtered(b), b.vectors, "source", "content", "url")
    return rt.citations(rt.with_fallback(hits, _tags(b)), F.col("fallback_url"))


@query("score_filter", f"select {_shown('query_id, tenant_id, source_type, vec_id, score')} from ({_FILTERED})")
def score_filter(b):
    return _rounded(_filtered(b), *_HIT)


@query("citations", f"select {_shown('query_id, tenant_id, source_type, vec_id, position, source, snippet, url, score')} from ({_CITED})")
def citations(b):
    return _rounded(_cited(b), *_HIT, "position", "source", "snippet", "url")


@query("context_block", _CONTEXTS)
def context_block(b):
    return rt.context_text(_cited(b)).select("query_id", "position", "context")


@query("context_budget", _PACKED)
def context_budget(b):
    return rt.pack_context(rt.context_text(_cited(b)))


_OPENING, _REST = rt.SYSTEM_PROMPT.split("{brand}")
_MIDDLE, _ENDING = _REST.split("{site}")
_SITE_HEAD, _SITE_TAIL = rt.SITE_CLAUSE.split("{site}")
_SITE = f"coalesce({sql.strip('t.widget_website_url')}, '')"


@query("prompt_assemble", f"""
select q.query_id, concat('{_OPENING}', {sql.brand('t.brand_name', 't.name')}, '{_MIDDLE}',
  case when {_SITE} <> '' then concat('{_SITE_HEAD}', {_SITE}, '{_SITE_TAIL}') else '' end, '{_ENDING}') as system_prompt,
  concat('Question: ', q.question, chr(10), chr(10), 'Context: ', c.context) as user_prompt
from ({_PACKED}) c join b_query_vectors q using (query_id) join b_tenants t on t.tenant_id = q.tenant_id
""")
def prompt_assemble(b):
    packed = rt.pack_context(rt.context_text(_cited(b)))
    asked = b.query_vectors.select("query_id", "tenant_id", "question")
    labels = b.tenants.select("tenant_id", "brand_name", "name", "widget_website_url")
    ready = packed.join(asked, "query_id").join(labels, "tenant_id")
    return rt.build_prompts(ready).select("query_id", "system_prompt", "user_prompt")


_CONFIDENCE = f"""
select q.query_id, case when exists (select 1 from ({_CITED}) c where c.query_id = q.query_id) then f.best else 0.0 end as confidence
from b_query_vectors q left join (select query_id, max(score) as best from ({_FILTERED}) group by 1) f using (query_id)
"""


@query("answer_confidence", f"select query_id, round(confidence, 6) as confidence from ({_CONFIDENCE})")
def answer_confidence(b):
    found = rt.cited_best(_filtered(b), b.vectors, _tags(b))
    return rt.answer_confidence(b.query_vectors, found).withColumn("confidence", F.round("confidence", 6))


_ROUTED = f"""
select m.message_id, m.session_id, m.tenant_id, m.created_at,
  case when bw.message_id is not null then 'block_word' when qr.message_id is not null then 'fuzzy' else 'vector_search' end as source,
  case when bw.message_id is not null then 1.0 when qr.message_id is not null then qr.confidence else coalesce(c.confidence, 0) end as confidence,
  case when bw.message_id is not null then bw.response_message when qr.message_id is not null then qr.response
    when coalesce(c.confidence, 0) = 0 then 'I could not find high-confidence context for that request.' end as response
from b_short_messages m
left join ({BLOCKED_SQL}) bw on bw.message_id = m.message_id
left join ({_ORACLES['quick_reply_match'].replace('with q as', 'with qs as').replace('from q join', 'from qs q join')}) qr on qr.message_id = m.message_id
left join ({_CONFIDENCE}) c on c.query_id = m.message_id
"""


def _routed(b):
    merged = rules.merge_rules(b.quick_replies, DEFAULTS, b.tenants)
    return cascade.route(b.short_messages, b.query_vectors, b.block_rules, merged, b.tenants, b.vectors, tags=_tags(b))


@query("message_route", f"select * replace (round(confidence, 6) as confidence) from ({_ROUTED})")
def message_route(b):
    return _routed(b).withColumn("confidence", F.round("confidence", 6))


@query("session_block_flag", f"""
select s.session_id, s.tenant_id, coalesce(r.blocked, false) as block_triggered, greatest(s.last_message_at, r.last_at) as last_message_at
from b_sessions s left join (
  select m.session_id, bool_or(bw.message_id is not null) as blocked, max(m.created_at) as last_at
  from b_short_messages m left join ({BLOCKED_SQL}) bw on bw.message_id = m.message_id group by 1) r using (session_id)
""")
def session_block_flag(b):
    from parley.operators.block_words import match_block_words

    # the flag needs only the first stage of the cascade
    hits = match_block_words(b.short_messages, b.block_rules).select("message_id", F.lit(cascade.BLOCK).alias("source"))
    staged = b.short_messages.join(hits, "message_id", "left").select(
        "session_id", "created_at", F.coalesce("source", F.lit(cascade.VECTOR)).alias("source")
    )
    flagged = cascade.flag_sessions(b.sessions, staged)
    return flagged.select("session_id", "tenant_id", "block_triggered", "last_message_at")


# ---- ingestion -------------------------------------------------------------


def _post_docs(b):
    sites = cms.site_url(b.options, b.tenants, SITE_DEFAULT)
    return ingest.cms_documents(b.posts, sites, cms.payload_tags(b.tenants))


def _url_docs(b):
    return ingest.external_documents(b.raw("pages"), cms.scan_urls(b.urls))


_BODY = sql.cut("concat(title, chr(10), chr(10), content)", 28000, "'...'")


# the hashing embedder fails only on a text without words, and every title has some
@query("embed_documents", f"""
select tenant_id, point_id, 64 as dims, cast(len(regexp_extract_all({_BODY}, '[\\pL\\pN_]+')) as int) as prompt_tokens, 'succeeded' as status
from ({POSTS_SQL})
""")
def embed_documents(b):
    embedded = ingest.embed(_post_docs(b))
    return embedded.select("tenant_id", "point_id", F.size("embedding").alias("dims"), "prompt_tokens", "status")


_PAYLOAD = ["tenant_id", "source_type", "point_id", "title", "url", "content", "source", "type", "date", "description"]


@query("ingest_cms", f"select {', '.join(_PAYLOAD[:-1])}, cast(null as varchar) as description from ({POSTS_SQL})")
def ingest_cms(b):
    path = shared_dir(b.spark, "collection")
    ingest.run(_post_docs(b), path, "cms")
    return vectors.read_vectors(b.spark, path).select(*_PAYLOAD)


@query("ingest_external", f"""
select distinct tenant_id, source_type, point_id, title, url, content, source, cast(null as varchar) as type, cast(null as varchar) as date, description
from ({EXTERNAL_SQL})
""")
def ingest_external(b):
    path = shared_dir(b.spark, "collection")
    ingest.run(_url_docs(b), path, "external")
    return vectors.read_vectors(b.spark, path).select(*_PAYLOAD)


@query("reindex_all", f"""
select t.tenant_id, 'nightly' as run_id, 'completed' as status, coalesce(d.n, 0) as total, coalesce(d.n, 0) as succeeded,
  cast(0 as bigint) as failed, cast(null as varchar) as error
from b_tenants t left join (
  select tenant_id, count(*) as n from (select tenant_id from ({POSTS_SQL}) union all select tenant_id from ({EXTERNAL_SQL})) group by 1) d using (tenant_id)
where t.status = 'active' and t.source_db_url <> ''
""")
def reindex_all(b):
    path, jobs = shared_dir(b.spark, "collection"), shared_dir(b.spark, "jobs")
    due = cms.due_tenants(b.tenants).select("tenant_id")
    documents = _post_docs(b).unionByName(_url_docs(b)).join(due, "tenant_id", "left_semi")
    ingest.reindex(documents, path, jobs, "nightly", due)
    return b.spark.read.parquet(jobs).select("tenant_id", "run_id", "status", "total", "succeeded", "failed", "error")


@query("index_usage", f"""
select tenant_id, 'cms' as run_id, 'index_embedding' as usage_type, cast(sum(n) as bigint) as prompt_tokens, cast(0 as bigint) as completion_tokens,
  cast(sum(n) as bigint) as total_tokens from (
  select tenant_id, len(regexp_extract_all({_BODY}, '[\\pL\\pN_]+')) as n from ({POSTS_SQL})) group by 1
""")
def index_usage(b):
    statuses = ingest.embed(_post_docs(b)).withColumn("run_id", F.lit("cms"))
    return ingest.index_usage(statuses)


# the embedder gives a document its own vector, so a search for its text finds it, or one with the same text and a smaller id
@query("ingest_search", f"""
select tenant_id, source_type, point_id, md5(body) as body, min(point_id) over (partition by tenant_id, source_type, lower(body)) as found
from (select *, {_BODY} as body from ({POSTS_SQL}))
""")
def ingest_search(b):
    path = shared_dir(b.spark, "collection")
    ingest.run(_post_docs(b), path, "cms")
    stored = vectors.read_vectors(b.spark, path).withColumn("embedding", F.col("embedding").cast("array<double>"))
    points = stored.withColumn("vec_id", F.col("point_id"))
    asked = stored.select("tenant_id", F.concat_ws("/", F.col("tenant_id").cast("string"), "point_id").alias("query_id"), F.col("embedding").alias("qe"))
    best = rt.topk(asked, points, k=1).select("query_id", F.col("vec_id").alias("found"))
    body = text.truncate_head_tail(text.embedding_text(F.col("title"), F.col("content")), text.EMBED_MAX_CHARS, "...")
    named = stored.withColumn("query_id", F.concat_ws("/", F.col("tenant_id").cast("string"), "point_id"))
    return named.join(best, "query_id").select("tenant_id", "source_type", "point_id", F.md5(body.cast("binary")).alias("body"), "found")
