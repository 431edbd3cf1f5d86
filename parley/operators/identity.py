"""Visitor identity: duplicates, profile merges, re-pointing, ratings, votes, slugs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import text
from parley.operators.groups import attach_group, lookup, newest, oldest, ranked
from parley.session import materialize


# ---- duplicate visitors ----------------------------------------------------


def _by_email(visitors: DataFrame) -> DataFrame:
    keyed = visitors.withColumn("email_norm", text.norm_email(F.col("email")))
    return keyed.where(F.col("email_norm") != "")


def canonical_visitors(visitors: DataFrame) -> DataFrame:
    """Earliest (created_at, id) profile of each tenant and e-mail; blank e-mails never group."""
    rows = _by_email(visitors).select("tenant_id", "email_norm", "created_at", "id", "visitor_id", "name", "email")
    return oldest(rows, ["tenant_id", "email_norm"], ["created_at", "id"])


def dedupe_mapping(visitors: DataFrame) -> DataFrame:
    """Duplicate -> canonical profile, one row per profile that goes away."""
    rows = _by_email(visitors)
    first = F.min(F.struct("created_at", "id", "visitor_id", "name", "email"))
    grouped = attach_group(rows, ["tenant_id", "email_norm"], {"_first": first}, slice_on="id")
    return grouped.where(F.col("id") != F.col("_first.id")).select(
        "tenant_id",
        "email_norm",
        F.col("id").alias("duplicate_id"),
        F.col("visitor_id").alias("duplicate_visitor_id"),
        F.col("_first.id").alias("canonical_id"),
        F.col("_first.visitor_id").alias("canonical_visitor_id"),
        F.col("_first.name").alias("canonical_name"),
        F.col("_first.email").alias("canonical_email"),
    )


def surviving_visitors(visitors: DataFrame, mapping: DataFrame) -> DataFrame:
    gone = mapping.select("tenant_id", F.col("duplicate_id").alias("id"))
    return visitors.join(gone, ["tenant_id", "id"], "left_anti")


def _moves(mapping: DataFrame) -> DataFrame:
    return mapping.select(
        "tenant_id", F.col("duplicate_visitor_id").alias("visitor_id"), "canonical_visitor_id", "canonical_name", "canonical_email"
    )


def repoint_sessions(sessions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sessions of duplicates take the canonical id, name and e-mail; ``repointed`` tells which."""
    moved = F.col("canonical_visitor_id").isNotNull()
    swap = lambda new, old: F.when(moved, F.col(new)).otherwise(F.col(old))
    return (
        sessions.join(_moves(mapping), ["tenant_id", "visitor_id"], "left")
        .withColumns(
            {
                "repointed": moved,
                "visitor_name": swap("canonical_name", "visitor_name"),
                "visitor_email": swap("canonical_email", "visitor_email"),
                "visitor_id": swap("canonical_visitor_id", "visitor_id"),
            }
        )
        .drop("canonical_visitor_id", "canonical_name", "canonical_email")
    )


def repoint_ratings(ratings: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ratings of duplicates take the canonical visitor id."""
    return (
        ratings.join(_moves(mapping), ["tenant_id", "visitor_id"], "left")
        .withColumns(
            {
                "repointed": F.col("canonical_visitor_id").isNotNull(),
                "visitor_id": F.coalesce("canonical_visitor_id", "visitor_id"),
            }
        )
        .drop("canonical_visitor_id", "canonical_name", "canonical_email")
    )


def dedupe_stats(visitors: DataFrame, mapping: DataFrame, sessions: DataFrame, ratings: DataFrame) -> DataFrame:
    """Scanned profiles, duplicate groups, removed profiles, re-pointed sessions and ratings, per tenant.

    Groups are counted by their canonical profile; sessions and ratings are
    counted per visitor before they meet the mapping.
    """
    scanned = visitors.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("visitors_scanned"))
    groups = mapping.groupBy("tenant_id").agg(
        F.count_distinct("email_norm").alias("duplicate_groups"), F.count(F.lit(1)).alias("duplicate_profiles_removed")
    )

    def moved(df: DataFrame, name: str) -> DataFrame:
        per_visitor = df.groupBy("tenant_id", "visitor_id").agg(F.count(F.lit(1)).alias("n"))
        hits = per_visitor.join(_moves(mapping).select("tenant_id", "visitor_id"), ["tenant_id", "visitor_id"], "left_semi")
        return hits.groupBy("tenant_id").agg(F.sum("n").alias(name))

    out = scanned
    for part in (groups, moved(sessions, "sessions_repointed"), moved(ratings, "ratings_repointed")):
        out = out.join(part, "tenant_id", "left")
    return out.na.fill(0)


def dedupe_preview(mapping: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` duplicate groups by tenant and e-mail, one row per duplicate, and whether more exist.

    Rows instead of a nested list: a group may hold a large part of all profiles.
    """
    groups = mapping.groupBy("tenant_id", "email_norm").agg(F.min("canonical_visitor_id").alias("canonical_visitor_id"))
    leading = groups.orderBy("tenant_id", "email_norm").limit(n)
    truncated = (groups.agg(F.count(F.lit(1)).alias("n")).scalar() > n).alias("preview_truncated")
    members = mapping.select("tenant_id", "email_norm", "duplicate_visitor_id")
    return members.join(leading, ["tenant_id", "email_norm"]).select(
        "tenant_id", "email_norm", "canonical_visitor_id", "duplicate_visitor_id", truncated
    )


def latest_profiles(visitors: DataFrame) -> DataFrame:
    """Newest updated profile of each tenant and e-mail."""
    rows = _by_email(visitors).select("tenant_id", "email_norm", "updated_at", "id", "visitor_id", "name", "email")
    return newest(rows, ["tenant_id", "email_norm"], ["updated_at", "id"])


# ---- merge-style batches ---------------------------------------------------


def resolve_profiles(visitors: DataFrame, submissions: DataFrame) -> DataFrame:
    """Profile each submission ends in: ``by_id``, ``by_email`` or ``insert``.

    Stored profiles are matched as they stand at the start of the batch.  Forms
    with a new id and a new e-mail share the profile that the earliest of them
    creates.
    """
    forms = submissions.select(
        "seq", "tenant_id", text.valid_visitor_id(F.col("visitor_id")).alias("visitor_id"),
        text.blank_to_null(F.col("name")).alias("name"), text.strip_ws(F.col("email")).alias("email"),
        text.norm_email(F.col("email")).alias("email_norm"), "submitted_at",
    ).where(F.col("visitor_id").isNotNull() & F.col("name").isNotNull() & (F.col("email_norm") != ""))
    stored = visitors.select("tenant_id", "visitor_id", F.lit(True).alias("_stored"))
    known = forms.join(stored, ["tenant_id", "visitor_id"], "left")
    by_email = latest_profiles(visitors).select("tenant_id", "email_norm", F.col("visitor_id").alias("_email_match"))
    first_form = F.min(F.when(F.col("_stored").isNull(), F.struct("submitted_at", "seq", "visitor_id")))
    grouped = attach_group(
        lookup(known, by_email, ["tenant_id", "email_norm"], slice_on="seq"),
        ["tenant_id", "email_norm"], {"_first": first_form}, slice_on="seq",
    )
    by_id = F.col("_stored").isNotNull()
    return grouped.select(
        "seq", "tenant_id", "visitor_id", "name", "email", "submitted_at",
        F.when(by_id, "by_id").when(F.col("_email_match").isNotNull(), "by_email").otherwise("insert").alias("matched"),
        F.when(by_id, F.col("visitor_id")).otherwise(F.coalesce("_email_match", "_first.visitor_id")).alias("resolved_visitor_id"),
    )


def merge_profiles(visitors: DataFrame, submissions: DataFrame) -> DataFrame:
    """Profile snapshot after a batch of forms: per profile the newest form wins."""
    resolved = resolve_profiles(visitors, submissions)
    last = newest(
        resolved.select("tenant_id", F.col("resolved_visitor_id").alias("visitor_id"), "submitted_at", "seq", "name", "email"),
        ["tenant_id", "visitor_id"], ["submitted_at", "seq"],
    ).select("tenant_id", "visitor_id", F.col("name").alias("_name"), F.col("email").alias("_email"), "submitted_at")
    joined = visitors.select("tenant_id", "visitor_id", "name", "email", "created_at", "updated_at").join(
        last, ["tenant_id", "visitor_id"], "full"
    )
    return joined.select(
        "tenant_id", "visitor_id", F.coalesce("_name", "name").alias("name"), F.coalesce("_email", "email").alias("email"),
        F.coalesce("created_at", "submitted_at").alias("created_at"), F.coalesce("submitted_at", "updated_at").alias("updated_at"),
    )


def merge_feedback(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One vote per message and user; the newest wins, incoming before stored at the same instant."""
    both = stored.withColumn("_from", F.lit(0)).unionByName(incoming.withColumn("_from", F.lit(1)))
    return newest(both, ["message_id", "user_id"], ["created_at", "_from"]).drop("_from")


def attach_visitors(sessions: DataFrame, visitors: DataFrame) -> DataFrame:
    """New sessions take name, e-mail and title from the visitor's profile."""
    profiles = visitors.select("tenant_id", "visitor_id", F.col("name").alias("visitor_name"), F.col("email").alias("visitor_email"))
    bare = sessions.drop("visitor_name", "visitor_email", "title")
    title = F.concat(F.col("visitor_name"), F.lit(" ("), F.col("visitor_email"), F.lit(")"))
    return bare.join(profiles, ["tenant_id", "visitor_id"], "left").withColumn("title", title)


def first_ratings(submissions: DataFrame, stored: DataFrame, sessions: DataFrame) -> DataFrame:
    """Accepted ratings: 1-5, valid visitor, session of the same tenant, none stored, first one per session."""
    valid = submissions.withColumn("visitor_id", text.valid_visitor_id(F.col("visitor_id"))).where(
        F.col("rating").between(1, 5) & F.col("visitor_id").isNotNull()
    )
    own = valid.join(sessions.select("session_id", "tenant_id"), ["session_id", "tenant_id"], "left_semi")
    fresh = own.join(stored.select("session_id"), "session_id", "left_anti")
    return oldest(fresh, ["session_id"], ["seq"])


# ---- slugs -----------------------------------------------------------------

_NUMBERED = "^(.+)-([2-9]|[1-9][0-9]+)$"
_ID_RANGE = 100_000
_SPAN_RANGE = 1_000


def _stem(slug):
    return F.regexp_replace(slug, "(-([2-9]|[1-9][0-9]+))+$", "")


def _closed_form(names: DataFrame, existing: DataFrame) -> DataFrame:
    """The ``r``-th name of a base takes its r-th free number; taken numbers become steps of constant shift."""
    own = F.struct(F.col("slug").alias("base"), F.lit(1).cast("bigint").alias("number"))
    numbered = F.struct(
        F.regexp_extract("slug", _NUMBERED, 1).alias("base"),
        F.regexp_extract("slug", _NUMBERED, 2).try_cast("bigint").alias("number"),
    )
    under = F.array_compact(F.array(own, F.when(F.col("slug").rlike(_NUMBERED), numbered)))
    counts = names.groupBy("base").agg(F.max("r").alias("n"))
    # numbers that do not fit are out of reach
    taken = existing.select(F.explode(under).alias("t")).select("t.*").where("number is not null").distinct().join(counts.select("base"), "base", "left_semi")
    nth = ranked(taken, ["base"], [F.asc("number")], F.floor(F.col("number") / _ID_RANGE), "j")
    # free numbers below the j-th taken one: names ranked past them shift by at least j
    steps = nth.groupBy("base", (F.col("number") - F.col("j")).alias("free")).agg(F.max("j").alias("shift"))
    placed = materialize(ranked(steps, ["base"], [F.asc("free")], F.floor(F.col("free") / _ID_RANGE), "step"), "slug-steps")
    following = placed.select("base", (F.col("step") - 1).alias("step"), F.col("free").alias("free_end"))
    until = F.least(F.coalesce("free_end", "n"), F.col("n"))
    rank_range = lambda c: F.floor(c / _SPAN_RANGE)
    # each step is listed under every range of ranks it covers, so a busy base joins range by range
    spans = (
        placed.join(following, ["base", "step"], "left")
        .join(counts, "base")
        .select(F.col("base").alias("_base"), "shift", "free", until.alias("free_end"))
        .where(F.col("free") < F.col("free_end"))
        .withColumn("_range", F.explode(F.sequence(rank_range(F.col("free") + 1), rank_range(F.col("free_end")))))
    )
    inside = (F.col("r") > F.col("free")) & (F.col("r") <= F.col("free_end"))
    same = (F.col("base") == F.col("_base")) & (rank_range(F.col("r")) == F.col("_range"))
    number = F.col("r") + F.coalesce("shift", F.lit(0))
    slug = F.when(number == 1, F.col("base")).otherwise(F.concat_ws("-", "base", number.cast("string")))
    return names.join(spans, same & inside, "left").select("id", "name", slug.alias("slug"))


def _one_by_one(names: pd.DataFrame, existing: pd.DataFrame) -> pd.DataFrame:
    """Names that can take each other's numbered slugs, in order of arrival."""
    taken = set(existing["slug"])
    next_number: dict[str, int] = {}
    slugs = []
    names = names.sort_values("id")
    for base in names["base"]:
        number = next_number.get(base, 1)
        slug = base if number == 1 else f"{base}-{number}"
        while slug in taken:
            number += 1
            slug = f"{base}-{number}"
        taken.add(slug)
        next_number[base] = number
        slugs.append(slug)
    return pd.DataFrame({"id": names["id"].values, "name": names["name"].values, "slug": slugs})


def unique_slugs(names: DataFrame, existing: DataFrame) -> DataFrame:
    """Slug per name in id order: the base, then ``-2``, ``-3``, ... skipping every slug already taken.

    Where bases such as ``shop`` and ``shop-2`` meet, a slug can depend on the
    order of arrival under either base, but only up to the greatest number
    ``n`` within reach that ends a base of the stem: a base's names beyond its
    first ``n`` always land past it, and no name gets past the count of all slugs.  Those first names are walked in order, one stem per
    group; all others are placed by rank.
    """
    # a number that does not fit, or is greater than the count of all slugs, is out of reach of every rank
    most = names.count() + existing.count()
    number = F.regexp_extract("base", _NUMBERED, 2).try_cast("bigint")
    number = F.when(number <= most, number).otherwise(F.lit(0).cast("bigint"))
    based = names.select("id", "name", text.slugify(F.col("name")).alias("base")).withColumn("stem", _stem(F.col("base")))
    ends = {"_low": F.min("base"), "_high": F.max("base"), "_reach": F.max(number)}
    marked = attach_group(based, ["stem"], ends, slice_on="id")
    # names to walk per base: none where the stem has one base only
    walk = F.when(F.col("_low") == F.col("_high"), F.lit(0)).otherwise(F.col("_reach"))
    ordered = ranked(marked, ["base"], [F.asc("id")], F.floor(F.col("id") / _ID_RANGE), "r")
    ordered = materialize(ordered.select("id", "name", "base", "stem", walk.alias("walk"), "r"), "slug-ranks")
    leading = ordered.where(F.col("r") <= F.col("walk")).select("id", "name", "base", "stem")
    others = ordered.where(F.col("r") > F.col("walk")).select("id", "name", "base", (F.col("r") - F.col("walk")).alias("r"))
    rivals = existing.select("slug", _stem(F.col("slug")).alias("stem")).join(
        leading.select("stem").distinct(), "stem", "left_semi"
    )
    schema = names.select("id", "name", F.lit("").alias("slug")).schema
    walked = leading.groupBy("stem").cogroup(rivals.groupBy("stem")).applyInPandas(_one_by_one, schema)
    walked = materialize(walked, "slug-walk")
    taken = existing.select("slug").unionByName(walked.select("slug"))
    return _closed_form(others, taken).unionByName(walked)
