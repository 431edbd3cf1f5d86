"""Screening of public traffic: blocked addresses and countries, and configuration checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import net, text
from parley.operators.groups import lookup
from parley.session import materialize

# Fixed values
COLOR = "^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"
SOURCE_TYPE = "^[a-zA-Z0-9_.-]{1,64}$"
MIN_IDLE_SECONDS = 5
MATCH_MODES = ["exact", "substring", "regex"]
COLOR_COLUMNS = [
    "widget_primary_color",
    "widget_user_message_color",
    "widget_bot_message_color",
    "widget_user_message_text_color",
    "widget_bot_message_text_color",
]
URL_COLUMNS = ["widget_website_url", "privacy_policy_url"]


def with_client_ip(requests: DataFrame, ipv6: bool = True) -> DataFrame:
    return requests.withColumn("client_ip", net.client_ip(F.col("forwarded_for"), F.col("peer"), ipv6))


def ip_screen(requests: DataFrame, blocked_ips: DataFrame, request_id: str = "request_id") -> DataFrame:
    """Add ``ip_blocked``: the request's canonical address is blocked for its tenant."""
    listed = blocked_ips.select("tenant_id", F.col("ip_address").alias("client_ip")).distinct().withColumn("_hit", F.lit(True))
    found = lookup(requests, listed, ["tenant_id", "client_ip"], request_id)
    return found.withColumn("ip_blocked", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _address_key(address: Column) -> Column:
    """Family and bits of an address, which sort as addresses do within a family; NULL for anything else."""
    return F.coalesce(_key4(net.ipv4_number(address)), F.concat(F.lit("6"), net.ipv6_key(address)))


def _key4(number: Column) -> Column:
    return F.concat(F.lit("4"), F.lpad(F.lower(F.hex(number)), 8, "0"))


def last_start(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Add ``range`` to ``points(key, ...)``: of ``ranges(key, range)`` the one with the greatest key up to the point's, NULL before the first.

    Points and starts are dealt out together by ranges of the key and written, so
    that a stretch of keys is one partition whose last start is carried forward by
    a window; what crosses a border comes from one row per partition.  The work
    follows the rows, however many starts share a prefix.
    """
    spark = points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    range_type = ranges.schema["range"].dataType
    both = points.withColumn("kind", F.lit(1)).withColumn("range", F.lit(None).cast(range_type))
    both = both.unionByName(ranges.select("key", F.lit(0).alias("kind"), "range"), allowMissingColumns=True)
    laid = materialize(both.repartitionByRange(parts, "key").withColumn("stretch", F.spark_partition_id()), "stretches")
    ends = laid.groupBy("stretch").agg(F.max_by(F.when(F.col("kind") == 0, F.col("range")), F.when(F.col("kind") == 0, F.col("key"))).alias("end"))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carried = ends.select("stretch", F.last("end", ignorenulls=True).over(before).alias("carried"))
    upto = Window.partitionBy("stretch").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = laid.withColumn("last", F.last("range", ignorenulls=True).over(upto)).where("kind = 1")
    return found.join(carried, "stretch").select(*points.columns, F.coalesce("last", "carried").alias("range"))


def with_country(requests: DataFrame, ranges: DataFrame, request_id: str = "request_id") -> DataFrame:
    """Add ``country_code`` by address range.

    ``ranges`` has ``ip_start`` and ``ip_end`` as 32-bit numbers for IPv4, or
    ``ip6_start`` and ``ip6_end`` as 32 hex digits for IPv6, and no overlaps.  Each
    distinct address is parsed once and finds the last range that starts at or
    before it (:func:`last_start`), however dense the ranges of its prefix are.
    """
    span = lambda high: F.struct(high.alias("high"), "country_code")
    starts = ranges.where("ip_start is not null").select(_key4(F.col("ip_start")).alias("key"), span(_key4(F.col("ip_end"))).alias("range"))
    if "ip6_start" in ranges.columns:
        key6 = lambda c: F.concat(F.lit("6"), F.lower(c))
        starts = starts.union(ranges.where("ip6_start is not null").select(key6("ip6_start").alias("key"), span(key6("ip6_end")).alias("range")))
    addresses = requests.select("client_ip").distinct().withColumn("key", _address_key(F.col("client_ip")))
    found = last_start(addresses, starts).where("key <= range.high").select("client_ip", "range.country_code")
    return lookup(requests, found, ["client_ip"], request_id)


def country_screen(requests: DataFrame, ranges: DataFrame, blocked_countries: DataFrame, request_id: str = "request_id") -> DataFrame:
    """Add ``country_code`` and ``country_blocked`` for the request's tenant."""
    listed = blocked_countries.select("tenant_id", F.upper("country_code").alias("country_code")).distinct()
    located = with_country(requests, ranges, request_id).withColumn("country_code", F.upper("country_code"))
    found = lookup(located, listed.withColumn("_hit", F.lit(True)), ["tenant_id", "country_code"], request_id)
    return found.withColumn("country_blocked", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _violations(df: DataFrame, kind: str, checks: list[tuple[str, Column, str]]) -> DataFrame:
    """Rows (tenant_id, kind, field, value, rule) for every check that fires."""
    fired = [
        F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("value"), F.lit(rule).alias("rule")))
        for name, bad, rule in checks
    ]
    found = df.select("tenant_id", F.lit(kind).alias("kind"), F.explode(F.array_compact(F.array(*fired))).alias("v"))
    return found.select("tenant_id", "kind", "v.*")


def tenant_violations(tenants: DataFrame) -> DataFrame:
    """Colours, URLs, source type, idle wait and quota of tenant rows; blank texts are unset, not wrong."""
    have = set(tenants.columns)
    checks = []
    for name in [c for c in COLOR_COLUMNS if c in have]:
        value = text.blank_to_null(F.col(name))
        checks.append((name, ~value.rlike(COLOR), "hex_color"))
    for name in [c for c in URL_COLUMNS if c in have]:
        value = text.blank_to_null(F.col(name))
        checks.append((name, ~value.rlike("^https?://"), "http_url"))
    if "widget_source_type" in have:
        value = text.blank_to_null(F.col("widget_source_type"))
        checks.append(("widget_source_type", ~value.rlike(SOURCE_TYPE), "source_type_form"))
    if "idle_rating_wait_seconds" in have:
        checks.append(("idle_rating_wait_seconds", F.col("idle_rating_wait_seconds") < MIN_IDLE_SECONDS, "at_least_5"))
    if "monthly_message_limit" in have:
        checks.append(("monthly_message_limit", F.col("monthly_message_limit") < 1, "positive"))
    return _violations(tenants, "tenant", checks)


def rule_violations(replies: DataFrame, block_rules: DataFrame) -> DataFrame:
    """Similarity thresholds outside 50-100, blank triggers, unknown match modes."""
    threshold = F.col("similarity_threshold")
    reply = _violations(
        replies,
        "quick_reply",
        [
            ("similarity_threshold", ~threshold.between(50, 100), "between_50_100"),
            ("trigger_phrase", text.norm_trigger(F.col("trigger_phrase")) == "", "filled"),
        ],
    )
    mode = F.lower(text.strip_ws(F.coalesce("match_mode", F.lit(""))))
    block = _violations(block_rules, "block_rule", [("match_mode", ~mode.isin(MATCH_MODES), "known_match_mode")])
    return reply.unionByName(block)


def block_list_violations(blocked_ips: DataFrame, blocked_countries: DataFrame, ipv6: bool = True) -> DataFrame:
    """Addresses that do not parse and country codes that are not two letters."""
    ip = text.strip_ws(F.coalesce("ip_address", F.lit("")))
    addresses = _violations(blocked_ips, "blocked_ip", [("ip_address", net.canonical_ip(ip, ipv6).isNull(), "ip_address")])
    code = text.strip_ws(F.coalesce("country_code", F.lit("")))
    countries = _violations(blocked_countries, "blocked_country", [("country_code", ~code.rlike(r"^\p{L}{2}$"), "two_letters")])
    return addresses.unionByName(countries)


def validate_config(tenants: DataFrame, replies: DataFrame, block_rules: DataFrame, blocked_ips: DataFrame, blocked_countries: DataFrame, ipv6: bool = True) -> DataFrame:
    """All configuration violations in one listing."""
    return (
        tenant_violations(tenants)
        .unionByName(rule_violations(replies, block_rules))
        .unionByName(block_list_violations(blocked_ips, blocked_countries, ipv6))
    )
