"""Profile forms in order: each form sees what the forms before it wrote.

A form goes to the profile with its visitor id; without one to the profile that
was written last among those holding its e-mail; without one it creates a profile.
A form that goes by e-mail leaves every e-mail where it is and its target the last
written one, so what later forms see depends on one thing only: at which form, if
any, each new visitor id is created.  That is found in rounds over all forms at
once, starting from no creation at all: under the creations assumed so far, an id is
created at its first form whose e-mail nobody holds.  A round gets right at least
the earliest creation that was wrong, with all that depends on right ones, and the
rounds end when nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text
from parley.operators.groups import lookup, newest, ranked
from parley.session import discard, materialize

_ORDER_RANGE = 50_000


def ordered_forms(submissions: DataFrame) -> DataFrame:
    """Valid forms with their place ``o`` (from 1) in the tenant's order of ``(submitted_at, seq)``."""
    forms = submissions.select(
        "seq", "tenant_id", text.valid_visitor_id(F.col("visitor_id")).alias("visitor_id"), text.blank_to_null(F.col("name")).alias("name"),
        text.strip_ws(F.col("email")).alias("email"), text.norm_email(F.col("email")).alias("email_norm"), "submitted_at",
    ).where("tenant_id is not null and visitor_id is not null and name is not null and email_norm <> ''")
    day = F.unix_date(F.to_date("submitted_at"))
    return ranked(forms, ["tenant_id"], [F.asc_nulls_first("submitted_at"), F.asc("seq")], day, "o")


def _stays(moves: DataFrame) -> DataFrame:
    """Each move of a profile to an e-mail with ``until``, the place of the profile's next move (null: none)."""
    numbered = ranked(moves, ["tenant_id", "visitor_id"], [F.asc("o")], F.floor(F.col("o") / _ORDER_RANGE), "k")
    following = numbered.select("tenant_id", "visitor_id", (F.col("k") - 1).alias("k"), F.col("o").alias("until"))
    return numbered.join(following, ["tenant_id", "visitor_id", "k"], "left").drop("k")


def _moves(forms: DataFrame, stored: DataFrame, created: DataFrame) -> DataFrame:
    """Moves under the creations assumed: stored e-mails at place 0, then all forms of existing profiles."""
    existing = forms.join(created, ["tenant_id", "visitor_id"], "left").where("known or o >= created")
    begun = stored.select("tenant_id", "visitor_id", "email_norm", F.lit(0).cast("bigint").alias("o"), "updated_at", "id")
    return begun.unionByName(existing.select("tenant_id", "visitor_id", "email_norm", "o"), allowMissingColumns=True)


def _unheld(forms: DataFrame, stays: DataFrame) -> DataFrame:
    """Forms with an id not stored whose e-mail nobody holds just before: a running sum in two levels."""
    change = lambda at, by: F.struct(F.col(at).alias("o"), F.lit(by).alias("by"))
    events = stays.where("email_norm <> ''").select("tenant_id", "email_norm", F.inline(F.array(change("o", 1), change("until", -1)))).where("o is not null")
    asking = forms.where("not known").select("tenant_id", "email_norm", "o", F.lit(0).alias("by"), "visitor_id")
    both = events.join(asking.select("tenant_id", "email_norm").distinct(), ["tenant_id", "email_norm"], "left_semi").unionByName(asking, allowMissingColumns=True)
    both = both.withColumn("part", F.floor(F.col("o") / _ORDER_RANGE))
    keys = ["tenant_id", "email_norm"]
    sums = both.groupBy(*keys, "part").agg(F.sum("by").alias("total"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    before = Window.partitionBy(*keys, "part").orderBy("o").rangeBetween(Window.unboundedPreceding, -1)
    within = both.withColumn("inside", F.coalesce(F.sum("by").over(before), F.lit(0))).where("visitor_id is not null")
    return within.join(offsets, [*keys, "part"]).where(F.col("offset") + F.col("inside") == 0)


def _creations(forms: DataFrame, stored: DataFrame) -> DataFrame:
    """``(tenant_id, visitor_id, created)``: the place of the form that creates each new profile."""
    keys = ["tenant_id", "visitor_id"]
    created = forms.select(*keys, F.col("o").alias("created")).limit(0)
    while True:
        unheld = _unheld(forms, _stays(_moves(forms, stored, created)))
        following = materialize(unheld.groupBy(*keys).agg(F.min("o").alias("created")), "profile-creations")
        settled = following.join(created, [*keys, "created"], "left_anti").isEmpty() and created.join(following, [*keys, "created"], "left_anti").isEmpty()
        if hasattr(created, "_written"):
            discard(created)
        created = following
        if settled:
            return created


def _last_holder(asking: DataFrame, stays: DataFrame, most: int) -> DataFrame:
    """The holder of each form's e-mail who was written last before it.

    A stay is cut into blocks of doubling size, two a level at most; a block keeps
    only its last written holder, and a form looks up the block of each level it
    lies in.  So neither a busy e-mail nor a long stay comes together anywhere.
    """
    levels = range(max(most + 1, 1).bit_length() + 1)
    top = F.lit(1 << (len(levels) - 1)).cast("bigint")
    first, end = F.col("o") + 1, F.coalesce(F.col("until") + 1, top)

    def blocks(level: int) -> list:
        a, b = F.ceil(first / F.lit(1 << level)), F.floor(end / F.lit(1 << level))
        block = lambda at: F.struct(F.lit(level).alias("level"), at.cast("bigint").alias("block"))
        return [F.when((a < b) & (a % 2 == 1), block(a)), F.when((a < b) & (b % 2 == 1), block(b - 1))]

    keys = ["tenant_id", "email_norm", "level", "block"]
    written = F.struct("o", "updated_at", "id", "visitor_id").alias("holder")
    cut = stays.where("email_norm <> ''").select("tenant_id", "email_norm", written, F.inline(F.array_compact(F.array(*[c for n in levels for c in blocks(n)]))))
    holders = cut.groupBy(*keys).agg(F.max("holder").alias("holder"))
    own = [F.struct(F.lit(n).alias("level"), F.shiftright("o", n).cast("bigint").alias("block")) for n in levels]
    points = asking.select("tenant_id", "email_norm", "seq", F.inline(F.array(*own)))
    found = lookup(points, holders, keys, slice_on="seq", how="inner")
    return found.groupBy("tenant_id", "seq").agg(F.max("holder").alias("holder")).select("tenant_id", "seq", F.col("holder.visitor_id").alias("_by_email"))


def resolve_in_order(visitors: DataFrame, submissions: DataFrame) -> DataFrame:
    """Profile each valid form ends in, and whether it got there ``by_id``, ``by_email`` or by ``insert``.

    ``seq`` tells forms of a tenant apart and breaks ties of ``submitted_at``.  Forms
    count as written after everything stored; stored profiles as written in the order
    of ``(updated_at, id)``.  Forms without tenant, visitor id, name or e-mail go
    nowhere.  A blank stored e-mail matches no form.
    """
    stored = visitors.select("tenant_id", "visitor_id", F.coalesce(text.norm_email(F.col("email")), F.lit("")).alias("email_norm"), "updated_at", "id")
    marks = stored.select("tenant_id", "visitor_id", F.lit(True).alias("known")).distinct()
    known = lookup(ordered_forms(submissions), marks, ["tenant_id", "visitor_id"], slice_on="seq")
    forms = materialize(known.withColumn("known", F.coalesce("known", F.lit(False))), "profile-forms")
    created = _creations(forms, stored)
    stays = materialize(_stays(_moves(forms, stored, created)), "profile-stays")
    placed = lookup(forms, created, ["tenant_id", "visitor_id"], slice_on="seq")
    matched = F.when(F.col("known") | (F.col("o") > F.col("created")), "by_id").when(F.col("o") == F.col("created"), "insert").otherwise("by_email")
    told = placed.withColumn("matched", matched)
    most = forms.agg(F.coalesce(F.max("o"), F.lit(0)).alias("o")).first()["o"]
    by_email = _last_holder(told.where("matched = 'by_email'"), stays, most)
    return told.join(by_email, ["tenant_id", "seq"], "left").select(
        "seq", "tenant_id", "visitor_id", "name", "email", "submitted_at", "o", "matched", F.coalesce("_by_email", "visitor_id").alias("resolved_visitor_id")
    )


def merge_in_order(visitors: DataFrame, submissions: DataFrame) -> DataFrame:
    """Profile snapshot after all forms in order: the last form of a profile gives its name and e-mail, the one that creates it its birth."""
    resolved = resolve_in_order(visitors, submissions).select(
        "tenant_id", F.col("resolved_visitor_id").alias("visitor_id"), "o", "name", "email", "submitted_at",
        F.when(F.col("matched") == "insert", F.col("submitted_at")).alias("begun"),
    )
    keys = ["tenant_id", "visitor_id"]
    last = newest(resolved.drop("begun"), keys, ["o"]).select(*keys, F.col("name").alias("_name"), F.col("email").alias("_email"), "submitted_at")
    born = resolved.groupBy(*keys).agg(F.max("begun").alias("begun"))
    joined = visitors.select(*keys, "name", "email", "created_at", "updated_at").join(last.join(born, keys), keys, "full")
    return joined.select(
        *keys, F.coalesce("_name", "name").alias("name"), F.coalesce("_email", "email").alias("email"),
        F.coalesce("created_at", "begun").alias("created_at"), F.coalesce("submitted_at", "updated_at").alias("updated_at"),
    )
