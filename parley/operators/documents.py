"""Documents out of CMS posts and fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import html, ids, text, urls
from parley.operators.groups import lookup, oldest
from parley.sources.cms import scan_posts

# Fixed values
EXTERNAL = "external"
UNAVAILABLE = "Content unavailable"


def build_post_docs(posts: DataFrame, sites: DataFrame, tags: DataFrame) -> DataFrame:
    """Published posts with clean text, repaired URL, payload fields and point id.

    ``sites`` (tenant, site_url) and ``tags`` (tenant, source_type,
    source_label) are joined to each other first, so the posts meet one small
    tenant table and are otherwise only projected.
    """
    tenant = tags.select("tenant_id", "source_type", "source_label").join(sites, "tenant_id")
    return lookup(scan_posts(posts), tenant, ["tenant_id"], "id", "inner").select(
        "tenant_id",
        "id",
        ids.cms_point_id(F.col("id")).alias("point_id"),
        "title",
        text.strip_html(F.col("content")).alias("content"),
        urls.slug_url(F.col("site_url"), F.col("post_name")).alias("url"),
        "type",
        F.col("post_date").cast("string").alias("date"),
        F.col("source_label").alias("source"),
        "source_type",
    )


def _one_page_per_url(pages: DataFrame) -> DataFrame:
    return oldest(pages.select("url", "page_id", "html"), ["url"], ["page_id"])


def build_external_docs(pages: DataFrame, url_rows: DataFrame) -> DataFrame:
    """A document per URL row: page text where the page yields any, else the placeholder.

    Pages are parsed once per URL, before the join, however many rows point at
    them, and only where a row does.  ``url_rows`` has tenant_id, id, url, title
    and description; blank URLs give no document.
    """
    rows = url_rows.where(F.coalesce("url", F.lit("")) != "")
    wanted = pages.join(rows.select("url").distinct(), "url", "left_semi")
    parsed = html.page_text(_one_page_per_url(wanted)).select("url", F.nullif("content", F.lit("")).alias("content"))
    host = urls.url_netloc(F.col("url"))
    made_title = urls.title_from_url(F.col("url"), F.col("title"))
    spare_title = F.coalesce(text.first_filled(F.col("title")), host)
    spare_text = F.coalesce(text.first_filled(F.col("description")), F.lit(UNAVAILABLE))
    found = F.col("content").isNotNull()
    return rows.join(parsed, "url", "left").select(
        "tenant_id",
        "id",
        ids.url_point_id(F.col("url")).alias("point_id"),
        "url",
        F.when(found, made_title).otherwise(spare_title).alias("title"),
        F.when(found, F.col("content")).otherwise(spare_text).alias("content"),
        host.alias("source"),
        F.lit(EXTERNAL).alias("source_type"),
        F.when(found, text.first_filled(F.col("description"))).alias("description"),
        found.alias("fetched"),
    )


def fallback_docs(url_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Placeholder documents of URLs without a fetched page."""
    rows = url_rows.where(F.coalesce("url", F.lit("")) != "").join(pages.select("url"), "url", "left_anti")
    host = urls.url_netloc(F.col("url"))
    return rows.select(
        "tenant_id",
        "id",
        "url",
        F.coalesce(text.first_filled(F.col("title")), host).alias("title"),
        F.coalesce(text.first_filled(F.col("description")), F.lit(UNAVAILABLE)).alias("content"),
        host.alias("source"),
        F.lit(EXTERNAL).alias("source_type"),
    )
