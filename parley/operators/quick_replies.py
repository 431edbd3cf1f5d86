"""Fuzzy quick replies."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text
from parley.operators.groups import lookup, top_per_group

# Fixed values
DEFAULT_THRESHOLD = 85
MAX_SUGGESTIONS = 5


@F.pandas_udf(T.IntegerType())
def _sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Rounded 0-100 sequence-match ratio; each distinct pair of a batch is scored once."""
    known: dict[tuple[str, str], int] = {}
    matcher = SequenceMatcher(None)
    pairs = list(zip(left, right))
    for pair in sorted(set(pairs), key=lambda p: p[1]):
        a, b = pair
        if not a or not b:
            known[pair] = 0
            continue
        if matcher.b != b:
            matcher.set_seq2(b)
        matcher.set_seq1(a)
        known[pair] = int(round(100 * matcher.ratio()))
    return pd.Series([known[p] for p in pairs], dtype="int32")


def similarity_ratio(left: Column, right: Column) -> Column:
    """0-100 ratio, not symmetric; 100 on equality, decided in the JVM."""
    return F.when(left == right, F.lit(100)).otherwise(_sequence_ratio(left, right))


def may_reach(left: Column, right: Column, threshold: Column) -> Column:
    """False only where the ratio cannot round to ``threshold``.

    Matched characters cannot exceed the shorter text, nor
    ``(la + lb - levenshtein) / 2``.  The cheap length test runs first.
    """
    total = F.length(left) + F.length(right)
    need = threshold - F.lit(0.5)
    short = 200 * F.least(F.length(left), F.length(right)) >= need * total
    return short & (100 * (total - F.levenshtein(left, right)) >= need * total)


def _longest_text(trigger: Column, threshold: Column) -> Column:
    """Length of the longest text that can still reach the threshold against a trigger."""
    return F.length(trigger) * (200 / F.greatest(threshold - F.lit(0.5), F.lit(0.5)) - 1)


def score_pairs(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct texts of each tenant beside the rules they reach, with score.

    Texts too long for any rule leave before the shuffle; the join compares a
    text with its own tenant's rules and the bound drops nearly all pairs before
    Python sees them.
    """
    threshold = F.coalesce("similarity_threshold", F.lit(DEFAULT_THRESHOLD))
    keyed = rules.withColumn("threshold", threshold)
    longest = keyed.agg(F.max(_longest_text(F.col("trigger_phrase"), F.col("threshold")))).scalar()
    texts = (
        messages.select("tenant_id", text.norm_trigger(F.col("content")).alias("query"))
        .where((F.col("query") != "") & (F.length("query") <= longest))
        .distinct()
    )
    reach = may_reach(F.col("query"), F.col("trigger_phrase"), F.col("threshold"))
    pairs = texts.join(keyed, "tenant_id").where(reach)
    scored = pairs.withColumn("score", similarity_ratio(F.col("query"), F.col("trigger_phrase")))
    return scored.where(F.col("score") >= F.col("threshold"))


def match_quick_replies(messages: DataFrame, rules: DataFrame, tenants: DataFrame) -> DataFrame:
    """Best rule per message: highest score, then priority, then rule order; an empty template is no match.

    ``rules`` come from :func:`parley.operators.rules.merge_rules`.  Matching and
    rendering happen once per distinct text of a tenant; only then do the
    messages look their text up, spread out even when most say the same.
    """
    choice = F.struct(
        "score", "priority", (~F.col("is_default")).alias("own"), (-F.col("ord")).alias("age"), "trigger_phrase", "response_template"
    )
    best = score_pairs(messages, rules).groupBy("tenant_id", "query").agg(F.max(choice).alias("b"))
    labels = tenants.select("tenant_id", "brand_name", "name", "widget_header_title", "widget_website_url")
    response = text.render_template(
        F.col("b.response_template"), F.col("brand_name"), F.col("name"), F.col("widget_header_title"), F.col("widget_website_url")
    )
    replies = best.where(F.col("b.response_template") != "").join(labels, "tenant_id", "left").select(
        "tenant_id", "query", F.col("b.trigger_phrase").alias("trigger_phrase"), F.col("b.score").alias("score"), response.alias("response")
    )
    asked = messages.select("message_id", "tenant_id", text.norm_trigger(F.col("content")).alias("query"))
    longest = rules.agg(
        F.max(_longest_text(F.col("trigger_phrase"), F.coalesce("similarity_threshold", F.lit(DEFAULT_THRESHOLD))))
    ).scalar()
    short = asked.where((F.col("query") != "") & (F.length("query") <= longest))
    found = lookup(short, replies, ["tenant_id", "query"], slice_on="message_id").where(F.col("score").isNotNull())
    return found.select(
        "message_id", "tenant_id", "trigger_phrase", "score", (F.col("score") / 100).alias("confidence"), "response"
    )


def suggest_phrases(messages: DataFrame, rules: DataFrame, limit: int = MAX_SUGGESTIONS) -> DataFrame:
    """Up to ``limit`` triggers that contain the text or are contained in it, in rule order."""
    asked = messages.select("message_id", "tenant_id", text.norm_trigger(F.col("content")).alias("query"))
    either = F.contains("trigger_phrase", "query") | F.contains("query", "trigger_phrase")
    listed = rules.select("tenant_id", "trigger_phrase", "is_default", "priority", "ord")
    hits = asked.join(listed, "tenant_id").where(either).drop("query")
    order = [F.asc("is_default"), F.desc("priority"), F.asc("ord")]
    return top_per_group(hits, ["message_id"], order, limit, "position").select(
        "message_id", "tenant_id", "position", "trigger_phrase"
    )
