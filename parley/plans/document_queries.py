"""Queries over text cleaning, URL repair and document building."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import html, ids, text, urls
from parley.operators import documents as docs
from parley.plans import sql_parts as sql
from parley.plans.registry import query
from parley.sources import cms

SITE_DEFAULT = "https://default.example.com/"


@query("html_strip_basic", f"select page_id, {sql.strip_html('html')} as content from pages")
def html_strip_basic(b):
    return b.raw("pages").select("page_id", text.strip_html(F.col("html"), unicode=False).alias("content"))


# On these pages markup is regular enough for patterns to find the same text as the parser.
_MARKUP = "(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>"


def _plain(html_sql: str) -> str:
    bare = f"regexp_replace({html_sql}, '{_MARKUP}', '', 'g')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        bare = f"replace({bare}, '{entity}', '{char}')"
    return f"regexp_replace({bare}, '&amp;?', '&', 'g')"


_FULL = _plain("html")
_MAIN = _plain("coalesce(nullif(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), ''), html)")
_SQUASHED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_PAGE_TEXT = f"case when length({_FULL}) > 300 then {_SQUASHED.format(_FULL)} else {_SQUASHED.format(_MAIN)} end"


@query("html_main_content", f"select page_id, {_SQUASHED.format(_MAIN)} as content from pages")
def html_main_content(b):
    parsed = html.with_page_texts(b.raw("pages").select("page_id", "html"))
    return parsed.select("page_id", text.squash_ws(F.col("main_text")).alias("content"))


@query("html_full_text", f"select page_id, {_PAGE_TEXT} as content from pages")
def html_full_text(b):
    return html.page_text(b.raw("pages").select("page_id", "html"))


@query("normalize_whitespace", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as content from documents")
def normalize_whitespace(b):
    return b.raw("documents").select("doc_id", text.squash_ws(F.col("text"), unicode=False).alias("content"))


_WORDS = "translate(regexp_extract(regexp_replace({p}, '/+$', ''), '[^/]*$'), '-_', '  ')"
_TITLE = (
    "case when {p} in ('', '/') then {h} else array_to_string(list_transform(regexp_extract_all("
    + _WORDS
    + r", '(\pL+|[^\pL]+)'), lambda x: concat(upper(x[1:1]), lower(x[2:]))), '') end"
)


@query("title_from_url", f"select page_id, {_TITLE.format(p=sql.path('url'), h=sql.host('url'))} as title from pages")
def title_from_url(b):
    return b.raw("pages").select("page_id", urls.title_from_url(F.col("url")).alias("title"))


@query("url_domain", f"select id, {sql.host('url')} as source from b_urls")
def url_domain(b):
    return b.urls.select("id", urls.url_netloc(F.col("url")).alias("source"))


_FIXED_URLS = f"select id, tenant_id, {sql.fixed('url')} as url from b_urls"


EXTERNAL_SQL = f"""
select u.tenant_id, u.id, {sql.uuid5('u.url')} as point_id, u.url, concat('External content from ', u.url) as title,
  coalesce(p.content, concat('External content fetched from ', u.url)) as content, {sql.host('u.url')} as source, 'external' as source_type,
  case when p.content is not null then concat('External content fetched from ', u.url) end as description
from ({_FIXED_URLS}) u left join (
  select url, nullif({_PAGE_TEXT}, '') as content from (
    select *, row_number() over (partition by url order by page_id) as rn from pages) where rn = 1) p on p.url = u.url
where u.url <> ''
"""


@query("external_document", EXTERNAL_SQL)
def external_document(b):
    return docs.build_external_docs(b.raw("pages"), cms.scan_urls(b.urls)).drop("fetched")


@query("fetch_fallback_document", f"""
select u.tenant_id, u.id, u.url, concat('External content from ', u.url) as title, concat('External content fetched from ', u.url) as content,
  {sql.host('u.url')} as source, 'external' as source_type
from ({_FIXED_URLS}) u where u.url <> '' and not exists (select 1 from pages p where p.url = u.url)
""")
def fetch_fallback_document(b):
    return docs.fallback_docs(cms.scan_urls(b.urls), b.raw("pages"))


@query("embedding_text", "select id, concat(title, chr(10), chr(10), content) as embedding_text from b_posts")
def embedding_text(b):
    return b.posts.select("id", text.embedding_text(F.col("title"), F.col("content")).alias("embedding_text"))


@query("truncate_head_tail", f"""
select doc_id, {sql.cut('text', 3000, "concat(chr(10), '...[content truncated]...', chr(10))")} as context_cut,
  md5({sql.cut('text', 28000, "'...'")}) as embed_cut_md5,
  md5(case when length(text) > 5000 then concat(left(text, 5000), '...', right(text, 1000)) else text end) as retry_cut_md5
from documents
""")
def truncate_head_tail(b):
    col = F.col("text")
    return b.raw("documents").select(
        "doc_id",
        text.truncate_head_tail(col, 3000).alias("context_cut"),
        F.md5(text.truncate_head_tail(col, text.EMBED_MAX_CHARS, "...")).alias("embed_cut_md5"),
        F.md5(text.truncate_fixed(col)).alias("retry_cut_md5"),
    )


@query("deterministic_point_id", f"""
select 'post' as kind, id, {sql.uuid5("concat('wp_', cast(id as varchar))")} as point_id from b_posts
union all select 'page', page_id, {sql.uuid5('url')} from pages
""")
def deterministic_point_id(b):
    posts = b.posts.select(F.lit("post").alias("kind"), "id", ids.cms_point_id(F.col("id")).alias("point_id"))
    pages = b.raw("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), ids.url_point_id(F.col("url")).alias("point_id"))
    return posts.unionByName(pages)


POSTS_SQL = f"""
select p.tenant_id, p.id, {sql.uuid5("concat('wp_', cast(p.id as varchar))")} as point_id, p.title, {sql.strip_html('p.content')} as content,
  {sql.slug('s.site_url', 'p.post_name')} as url, p.type, cast(p.post_date as varchar) as date, t.source_label as source, t.source_type
from b_posts p join ({sql.SITES}) s using (tenant_id) join ({sql.TAGS}) t using (tenant_id)
where p.status = 'publish' and p.content <> ''
"""


@query("build_cms_documents", POSTS_SQL)
def build_cms_documents(b):
    sites = cms.site_url(b.options, b.tenants, SITE_DEFAULT)
    return docs.build_post_docs(b.posts, sites, cms.payload_tags(b.tenants))


# URL operators run on the repaired-and-broken URL list and on the raw page URLs
_ALL_URLS = "(select id, 'list' as kind, url from b_urls union all select page_id, 'page', url from pages)"


def _all_urls(b):
    listed = b.urls.select("id", F.lit("list").alias("kind"), "url")
    return listed.unionByName(b.raw("pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), "url"))


@query("url_is_valid", f"select id, kind, {sql.valid('url')} as valid from {_ALL_URLS}")
def url_is_valid(b):
    return _all_urls(b).select("id", "kind", urls.is_valid_url(F.col("url")).alias("valid"))


@query("url_base", f"select id, kind, {sql.root('url', '/')} as base_url from {_ALL_URLS}")
def url_base(b):
    return _all_urls(b).select("id", "kind", urls.base_url(F.col("url")).alias("base_url"))


@query("url_contact_fallback", f"select id, kind, {sql.root('url', '/contact-us/')} as contact_url from {_ALL_URLS}")
def url_contact_fallback(b):
    return _all_urls(b).select("id", "kind", urls.contact_url(F.col("url")).alias("contact_url"))


_SPARE = "'https://spare.example.com/'"


@query("url_validate_and_fix", f"select id, kind, {sql.fixed('url', _SPARE)} as url from {_ALL_URLS}")
def url_validate_and_fix(b):
    spare = F.lit("https://spare.example.com/")
    return _all_urls(b).select("id", "kind", urls.fix_url(F.col("url"), spare).alias("url"))


@query("url_from_slug", f"""
select p.id, {sql.slug('s.site_url', 'p.post_name')} as url from b_posts p join ({sql.SITES}) s using (tenant_id)
""")
def url_from_slug(b):
    sites = cms.site_url(b.options, b.tenants, SITE_DEFAULT)
    return b.posts.join(sites, "tenant_id").select("id", urls.slug_url(F.col("site_url"), F.col("post_name")).alias("url"))


@query("url_batch_fix", f"""
select id, {sql.fixed('url')} as url, concat({sql.fixed('url')}, ' ', {sql.fixed("concat('@', url)")}) as fixed_list,
  {sql.fixed('url')} as record_url, id as record_no from b_urls
""")
def url_batch_fix(b):
    fixed = urls.fix_urls(b.urls.withColumn("raw", F.col("url")), ["url"])
    raw = F.col("raw")
    record = urls.fix_url_records(F.array(F.struct(raw.alias("url"), F.col("id").alias("no"))))[0]
    return fixed.select(
        "id",
        "url",
        F.array_join(urls.fix_url_array(F.array(raw, F.concat(F.lit("@"), raw))), " ").alias("fixed_list"),
        record["url"].alias("record_url"),
        record["no"].alias("record_no"),
    )
