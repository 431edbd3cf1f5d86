"""Profile forms in order against a sequential model."""

import datetime as dt
import random

import pytest

from parley.operators import profiles

VISITORS = "id bigint, tenant_id bigint, visitor_id string, name string, email string, created_at timestamp_ntz, updated_at timestamp_ntz"
FORMS = "seq bigint, tenant_id bigint, visitor_id string, name string, email string, submitted_at timestamp_ntz"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def one_by_one(visitors, forms):
    """(seq -> (matched, target)) and (tenant, visitor) -> (name, email, created, updated)."""
    state, written, told = {}, {}, {}
    for n, (_, tenant, visitor, name, email, created, updated) in enumerate(sorted(visitors, key=lambda v: (v[6], v[0]))):
        state[tenant, visitor] = [name, email, created, updated]
        written[tenant, visitor] = n
    clock = len(visitors)
    for seq, tenant, visitor, name, email, when in sorted(forms, key=lambda f: (f[5], f[0])):
        visitor, name, email = (visitor or "").strip(), (name or "").strip(), (email or "").strip()
        if not (visitor and name and email):
            continue
        clock += 1
        holders = [k for k, v in state.items() if k[0] == tenant and (v[1] or "").strip().lower() == email.lower()]
        if (tenant, visitor) in state:
            how, key = "by_id", (tenant, visitor)
        elif holders:
            how, key = "by_email", max(holders, key=written.get)
        else:
            how, key = "insert", (tenant, visitor)
        state[key] = [name, email, state[key][2] if key in state else when, when]
        written[key] = clock
        told[seq] = (how, key[1])
    return told, {k: tuple(v) for k, v in state.items()}


def both(spark, visitors, forms):
    v, f = spark.createDataFrame(visitors, VISITORS), spark.createDataFrame(forms, FORMS).repartition(3)
    told = {r.seq: (r.matched, r.resolved_visitor_id) for r in profiles.resolve_in_order(v, f).collect()}
    merged = profiles.merge_in_order(v, f).collect()
    assert len(merged) == len({(r.tenant_id, r.visitor_id) for r in merged})
    return told, {(r.tenant_id, r.visitor_id): (r.name, r.email, r.created_at, r.updated_at) for r in merged}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_random_batches(spark, seed):
    rng = random.Random(seed)
    mail = lambda: rng.choice(["A@x", "a@x ", "b@x", "c@x", "d@x", "e@x", "f@x"])
    visitors = [(i, i % 2, f"v{i}", "Old", rng.choice([mail(), " ", None]), at(0), at(rng.randrange(9))) for i in range(8)]
    forms = [(s, s % 2, rng.choice([f"v{rng.randrange(12)}", f" n{rng.randrange(14)} "]), f"F{s}", mail(), at(20 + rng.randrange(60))) for s in range(90)]
    assert both(spark, visitors, forms) == one_by_one(visitors, forms)


def test_chain_of_created_ids(spark):
    """Each creation decides the next: n0 takes m0, moves on to m1, so n1 goes by e-mail and creates nothing, and so on."""
    forms = []
    for k in range(6):
        forms += [(3 * k, 1, f"n{k}", "A", f"m{k}@x", at(3 * k)), (3 * k + 1, 1, f"n{k}", "B", f"m{k + 1}@x", at(3 * k + 1)), (3 * k + 2, 1, f"k{k}", "C", f"m{k}@x", at(3 * k + 2))]
    assert both(spark, [], forms) == one_by_one([], forms)


def test_one_email_for_most_forms(spark):
    visitors = [(i, 1, f"v{i}", "Old", "hot@x", at(0), at(1)) for i in range(20)]
    forms = [(s, 1 if s % 3 else 2, f"n{s}" if s % 5 else f"v{s % 20}", "F", "hot@x" if s % 7 else f"own{s}@x", at(5)) for s in range(200)]
    assert both(spark, visitors, forms) == one_by_one(visitors, forms)


def test_forms_that_go_nowhere_and_empty_tables(spark):
    visitors = [(1, 1, "v1", None, None, at(0), at(1))]
    forms = [(1, 1, " ", "N", "a@x", at(2)), (2, 1, "n", None, "a@x", at(2)), (3, 1, "n", "N", " ", at(2)), (4, 1, None, "N", "a@x", at(2))]
    assert both(spark, visitors, forms) == one_by_one(visitors, forms) == ({}, {(1, "v1"): (None, None, at(0), at(1))})
    assert both(spark, visitors, []) == one_by_one(visitors, [])
