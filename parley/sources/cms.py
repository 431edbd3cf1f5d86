"""CMS content: posts, site options, URL lists and the connection settings behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text, urls
from parley.operators.groups import oldest

# Fixed values
DEFAULT_PORT = 3306
PUBLISHED = "publish"
SITE_OPTION = "siteurl"
ACTIVE = "active"

#: Stand-in payload tags for tenants that set none.
DEFAULT_SOURCE_TYPE = "primary"
DEFAULT_SOURCE_LABEL = "website"

_POST_COLUMNS = {
    "ID": "id",
    "post_title": "title",
    "post_content": "content",
    "post_type": "type",
    "post_status": "status",
    "post_name": "post_name",
    "post_date": "post_date",
}


def read_table(spark: SparkSession, table: str, options: dict[str, str]) -> DataFrame:
    """A CMS table over JDBC when ``url`` is given, else from files (``path`` and ``format``).

    Give ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` for a parallel JDBC scan.
    """
    opts = dict(options)
    if "url" in opts:
        return spark.read.format("jdbc").options(**{**opts, "dbtable": table}).load()
    root = opts.pop("path").rstrip("/")
    return spark.read.format(opts.pop("format", "parquet")).options(**opts).load(f"{root}/{table}")


def read_posts(spark: SparkSession, options: dict[str, str], table_prefix: str = "wp_") -> DataFrame:
    """Posts table under its own column names."""
    raw = read_table(spark, f"{table_prefix}posts", options)
    return raw.select(*[F.col(source).alias(name) for source, name in _POST_COLUMNS.items()])


def scan_posts(posts: DataFrame, newest_first: bool = False) -> DataFrame:
    """Published posts with content.

    Both predicates reach a parquet or JDBC scan.  Sorting is off by default:
    nothing downstream depends on it.
    """
    rows = posts.where((F.col("status") == PUBLISHED) & (F.col("content") != "")).drop("status")
    return rows.orderBy(F.desc("post_date"), F.asc("id")) if newest_first else rows


def site_url(options: DataFrame, tenants: DataFrame, default: str) -> DataFrame:
    """Site URL per tenant with a trailing slash; first option row wins, ``default`` when absent."""
    first = oldest(
        options.where(F.col("option_name") == SITE_OPTION).select("tenant_id", "option_id", "option_value"),
        ["tenant_id"],
        ["option_id"],
    )
    value = F.col("option_value")
    with_slash = F.when(F.endswith(value, F.lit("/")), value).otherwise(F.concat(value, F.lit("/")))
    return tenants.select("tenant_id").join(first, "tenant_id", "left").select(
        "tenant_id", F.coalesce(with_slash, F.lit(default)).alias("site_url")
    )


def scan_urls(url_rows: DataFrame, fallback=None) -> DataFrame:
    """URL table rows with repaired URL, made-up title and description."""
    fixed = url_rows.withColumn("url", urls.fix_url(F.col("url"), fallback))
    return fixed.withColumns(
        {
            "title": F.concat(F.lit("External content from "), F.col("url")),
            "description": F.concat(F.lit("External content fetched from "), F.col("url")),
        }
    )


def parse_dsn(df: DataFrame, dsn: str, table_prefix: str = "source_table_prefix", url_table: str = "source_url_table") -> DataFrame:
    """Connection parts of a DSN column; a blank DSN leaves all but prefix and URL table NULL."""
    given = F.when(F.coalesce(F.col(dsn), F.lit("")) != "", F.col(dsn))
    location = urls.url_netloc(given)
    user_info = F.when(F.contains(location, F.lit("@")), F.regexp_extract(location, "^(.*)@", 1))
    host_info = F.regexp_extract(location, "([^@]*)$", 1)
    # '+' is literal in a DSN, but the built-in decodes it to a space
    decode = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    filled = lambda c: decode(F.nullif(c, F.lit("")))
    port = F.regexp_extract(host_info, r"(?:^|\]|^[^\[\]:]*):(\d+)$", 1)
    host = F.coalesce(
        F.nullif(F.regexp_extract(host_info, r"^\[([^\]]*)\]", 1), F.lit("")), F.regexp_extract(host_info, "^([^:]*)", 1)
    )
    present = given.isNotNull()
    return df.withColumns(
        {
            "host": F.when(present, F.lower(host)),
            "port": F.when(present, F.coalesce(F.nullif(port.try_cast("int"), F.lit(0)), F.lit(DEFAULT_PORT))),
            "database": F.when(present, F.regexp_replace(urls.url_path(given), "^/+", "")),
            "user": filled(F.regexp_extract(user_info, "^([^:]*)", 1)),
            "password": filled(F.regexp_extract(user_info, "^[^:]*:(.*)$", 1)),
            "table_prefix": F.col(table_prefix),
            "url_table": F.col(url_table),
        }
    )


def payload_tags(tenants: DataFrame, source_type: str = DEFAULT_SOURCE_TYPE, label: str = DEFAULT_SOURCE_LABEL) -> DataFrame:
    """Source type, label and fallback URL that an ingest run stamps on a tenant's documents."""
    return tenants.select(
        "tenant_id",
        F.coalesce(text.blank_to_null(F.col("widget_source_type")), F.lit(source_type)).alias("source_type"),
        F.coalesce(text.blank_to_null(text.first_filled(F.col("brand_name"), F.col("name"))), F.lit(label)).alias("source_label"),
        text.blank_to_null(F.col("widget_website_url")).alias("fallback_url"),
    )


def due_tenants(tenants: DataFrame, **defaults: str) -> DataFrame:
    """Active tenants with a source database, with their payload tags."""
    due = tenants.where((F.col("status") == ACTIVE) & (F.col("source_db_url") != ""))
    return payload_tags(due, **defaults)
