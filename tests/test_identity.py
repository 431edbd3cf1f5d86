"""Identity operators against sequential models."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from parley.operators import access, identity, rules


def slugs_one_by_one(names, existing):
    taken, out = set(existing), {}
    for key, name in names:
        base = re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "tenant"
        slug, n = base, 1
        while slug in taken:
            n += 1
            slug = f"{base}-{n}"
        taken.add(slug)
        out[key] = slug
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_unique_slugs(spark, seed):
    rng = random.Random(seed)
    pool = ["Shop"] * 6 + ["shop 2", "Shop-3", "shop 2 2", "shop 12", "Cafe", "café", "!!", "Bar 7", "bar-007", "Bar"]
    names = [(i, rng.choice(pool)) for i in range(160)]
    existing = ["shop-2", "shop-5", "cafe", "cafe-3", "bar-7-2", "tenant-2", "other", "shop-2-3"]
    got = identity.unique_slugs(
        spark.createDataFrame(names, "id bigint, name string").repartition(5), spark.createDataFrame([(e,) for e in existing], "slug string")
    ).collect()
    assert {r.id: r.slug for r in got} == slugs_one_by_one(names, existing)
    assert len(got) == len(names)


def test_dedupe_is_idempotent(bindings):
    mapping = identity.dedupe_mapping(bindings.visitors)
    kept = identity.surviving_visitors(bindings.visitors, mapping)
    assert mapping.count() + kept.count() == bindings.visitors.count()
    assert identity.dedupe_mapping(kept).count() == 0
    moved = identity.repoint_sessions(bindings.sessions, mapping).drop("repointed")
    assert identity.repoint_sessions(moved, identity.dedupe_mapping(kept)).where("repointed").count() == 0
    assert moved.count() == bindings.sessions.count()


def test_blank_emails_never_group(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, 1, f"v{i}", "n", email, at, at) for i, email in enumerate([None, "", "  ", "\t", "A@x ", "a@X"])]
    visitors = spark.createDataFrame(rows, "id bigint, tenant_id bigint, visitor_id string, name string, email string, created_at timestamp_ntz, updated_at timestamp_ntz")
    mapping = identity.dedupe_mapping(visitors).collect()
    assert [(r.duplicate_id, r.canonical_id) for r in mapping] == [(5, 4)]


def test_profile_merge_order(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    visitors = spark.createDataFrame(
        [(1, 1, "v1", "Old", "a@x", at(0), at(1)), (2, 1, "v2", "Newer", "A@x", at(0), at(2))],
        "id bigint, tenant_id bigint, visitor_id string, name string, email string, created_at timestamp_ntz, updated_at timestamp_ntz",
    )
    forms = spark.createDataFrame(
        [
            (1, 1, " v1 ", "By id", "c@x", at(5)),
            (2, 1, "n1", "By mail", " a@X ", at(6)),
            (3, 1, "n2", "First new", "z@x", at(7)),
            (4, 1, "n3", "Second new", "Z@x", at(8)),
            (5, 1, "n4", " ", "q@x", at(8)),
            (6, 1, " ", "No id", "q@x", at(8)),
        ],
        "seq bigint, tenant_id bigint, visitor_id string, name string, email string, submitted_at timestamp_ntz",
    )
    resolved = {r.seq: (r.matched, r.resolved_visitor_id) for r in identity.resolve_profiles(visitors, forms).collect()}
    assert resolved == {1: ("by_id", "v1"), 2: ("by_email", "v2"), 3: ("insert", "n2"), 4: ("insert", "n2")}
    merged = {r.visitor_id: (r.name, r.email) for r in identity.merge_profiles(visitors, forms).collect()}
    assert merged == {"v1": ("By id", "c@x"), "v2": ("By mail", "a@X"), "n2": ("Second new", "Z@x")}


def test_scope(bindings):
    users, members = bindings.users, bindings.memberships
    admin = users.where("role = 'admin'").first().user_id
    boss = users.where("role = 'superadmin'").first().user_id
    own = {r.tenant_id for r in members.where(F.col("user_id") == admin).collect()}
    seen = access.scope(bindings.messages, users, members, admin)
    assert {r.tenant_id for r in seen.select("tenant_id").distinct().collect()} <= own
    assert seen.count() == bindings.messages.where(F.col("tenant_id").isin(own)).count()
    assert access.scope(bindings.messages, users, members, boss).count() == bindings.messages.count()
    outside = next(t for t in range(25) if t not in own)
    assert access.scope(bindings.messages, users, members, admin, outside).count() == 0


def test_rule_merge_revives_default_of_a_disabled_row(spark):
    tenants = spark.createDataFrame([(1,), (2,)], "tenant_id bigint")
    replies = spark.createDataFrame(
        [(1, "c", " Hello ", "own", None, 10, True, 1), (1, "c", "help", "off", None, 5, False, 2), (1, "c", " ", "blank", None, 1, True, 3)],
        "tenant_id bigint, category string, trigger_phrase string, response_template string, similarity_threshold int, priority int, enabled boolean, ord int",
    )
    merged = rules.merge_rules(replies, [("hello", "d1"), ("help", "d2")], tenants)
    assert sorted((r.tenant_id, r.trigger_phrase, r.response_template) for r in merged.collect()) == [
        (1, "hello", "own"), (1, "help", "d2"), (2, "hello", "d1"), (2, "help", "d2"),
    ]
    seeded = rules.seed_replies(tenants, replies, [("g", " Hi ", "t", 10)])
    assert [(r.tenant_id, r.trigger_phrase) for r in seeded.collect()] == [(2, "hi")]


def test_nested_words_in_order(spark):
    words = spark.createDataFrame([(1, "c", i * 700, f"w{i}") for i in range(25)], "tenant_id bigint, category string, word_ord bigint, word string")
    got = {r.position: r.word for r in rules.nest_words(words, ["tenant_id", "category"]).collect()}
    assert got == {i + 1: f"w{i}" for i in range(25)}


def test_slugs_with_very_long_numbers(spark):
    names = [(1, "Shop"), (2, "Shop " + "9" * 20), (3, "Shop"), (4, "Other"), (5, "Shop " + "8" * 40), (6, "Shop 20240101"), (7, "Shop 2"), (8, "Shop")]
    got = identity.unique_slugs(spark.createDataFrame(names, "id bigint, name string"), spark.createDataFrame([("shop-3",)], "slug string"))
    assert {r.id: r.slug for r in got.collect()} == slugs_one_by_one(names, ["shop-3"])
