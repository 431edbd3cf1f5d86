"""Rule tables: listing order, nesting, seeding and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text
from parley.operators.groups import newest, ranked

#: Fields of a preset or default reply, given as a plain list in code.
PRESET_FIELDS = ["category", "trigger_phrase", "response_template", "priority"]


def order_rules(replies: DataFrame) -> DataFrame:
    """Category, then highest priority, then trigger."""
    return replies.orderBy("tenant_id", F.asc("category"), F.desc("priority"), F.asc("trigger_phrase"))


def nest_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words under their category, each with its ``position`` from 1 on, oldest first.

    ``words`` has the category columns ``keys``, ``word_ord`` and ``word``.  The
    nesting stays rows, so that a category of any size is spread out.
    """
    stretch = F.floor(F.col("word_ord") / 1_000)
    numbered = ranked(words.select(*keys, "word_ord", "word"), keys, [F.asc("word_ord")], stretch)
    return numbered.select(*keys, F.col("rn").cast("bigint").alias("position"), "word")


def _preset_rows(preset: list[tuple]) -> Column:
    """The preset as one array literal with its list position, to be exploded beside each tenant."""
    rows = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(PRESET_FIELDS, row)], F.lit(i).alias("ord"))
        for i, row in enumerate(preset, start=1)
    ]
    return F.explode(F.array(*rows))


def seed_replies(tenants: DataFrame, replies: DataFrame, preset: list[tuple]) -> DataFrame:
    """Preset rows (category, trigger, template, priority) for tenants that have no reply row at all."""
    bare = tenants.select("tenant_id").join(replies.select("tenant_id"), "tenant_id", "left_anti")
    seeded = bare.select("tenant_id", _preset_rows(preset).alias("p")).select("tenant_id", "p.*")
    return seeded.withColumns(
        {
            "trigger_phrase": text.norm_trigger(F.col("trigger_phrase")),
            "similarity_threshold": F.lit(None).cast("int"),
            "enabled": F.lit(True),
        }
    )


def merge_rules(replies: DataFrame, defaults: list[tuple], tenants: DataFrame) -> DataFrame:
    """Enabled tenant rules plus each default whose trigger the tenant lacks.

    Only enabled rows count, so a disabled row brings its default back.  Rule
    order is priority (highest first), then age; defaults follow in list order
    with priority 0: sort by ``is_default``, ``priority`` descending, ``ord``.
    """
    named = replies.where("enabled").select(
        "tenant_id", text.norm_trigger(F.col("trigger_phrase")).alias("trigger_phrase"), "response_template",
        "similarity_threshold", "priority", "ord", F.lit(False).alias("is_default"),
    ).where(F.col("trigger_phrase") != "")
    own = newest(named, ["tenant_id", "trigger_phrase"], ["ord"])  # of phrases that normalise alike the later row counts
    if not defaults:
        return own
    rows = [(None, trigger.strip().lower(), template, 0) for trigger, template in defaults]
    spare = tenants.select("tenant_id", _preset_rows(rows).alias("p")).select(
        "tenant_id", "p.trigger_phrase", "p.response_template", F.lit(None).cast("int").alias("similarity_threshold"),
        "p.priority", "p.ord", F.lit(True).alias("is_default"),
    )
    lacking = spare.join(own.select("tenant_id", "trigger_phrase"), ["tenant_id", "trigger_phrase"], "left_anti")
    return own.unionByName(lacking)
