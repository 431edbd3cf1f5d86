"""Ranking and look-ups with one group that holds a third of all rows, against brute force."""

import datetime as dt
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parley import session
from parley.operators import analytics, groups
from parley.sources import transcripts


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(200)}"
        out.append((i, key, rng.randrange(1000)))
    out.append((3000, None, 5))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id bigint, key string, value bigint").repartition(6)


def by_key(rows):
    grouped = defaultdict(list)
    for r in rows:
        grouped[r[1]].append(r)
    return grouped


def test_ranked(df, rows):
    got = groups.ranked(df, ["key"], [F.asc("value"), F.asc("id")], F.floor(F.col("value") / 100))
    want = set()
    for key, members in by_key(rows).items():
        for n, r in enumerate(sorted(members, key=lambda r: (r[2], r[0])), 1):
            want.add((r[0], key, r[2], n))
    assert {tuple(r) for r in got.select("id", "key", "value", "rn").collect()} == want


def test_attach_group_spreads_the_hot_key(df, rows):
    got = groups.attach_group(df.where("key is not null"), ["key"], {"n": F.count(F.lit(1)), "low": F.min("value")}, "id")
    grouped = by_key(rows)
    want = {(r[0], r[1], r[2], len(grouped[r[1]]), min(m[2] for m in grouped[r[1]])) for r in rows if r[1]}
    assert {tuple(r) for r in got.select("id", "key", "value", "n", "low").collect()} == want
    sliced = df.where("key = 'hot'").select(F.pmod(F.xxhash64("id"), F.lit(groups.SLICES)).alias("s")).groupBy("s").count()
    assert sliced.count() > 40


def test_lookup_is_a_left_join(spark, df, rows):
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("absent", 3)], "key string, tag int")
    got = groups.lookup(df, right, ["key"], "id").select("id", "tag").collect()
    tags = {"hot": 1, "k1": 2}
    assert sorted((r.id, r.tag) for r in got) == sorted((r[0], tags.get(r[1])) for r in rows)


def test_newest_and_oldest(df, rows):
    new = {r.key: (r.value, r.id) for r in groups.newest(df, ["key"], ["value", "id"]).collect()}
    old = {r.key: (r.value, r.id) for r in groups.oldest(df, ["key"], ["value", "id"]).collect()}
    for key, members in by_key(rows).items():
        assert new[key] == max((m[2], m[0]) for m in members)
        assert old[key] == min((m[2], m[0]) for m in members)


def test_pages_cover_the_whole_list(df, rows):
    order = [F.desc("value"), F.asc("id")]
    seen = []
    for page in range(1, 12):
        part = analytics.paginate(df.where("key = 'hot'"), ["key"], order, page, 100).collect()
        seen += [r.id for r in sorted(part, key=lambda r: r.position)]
        assert {r.total for r in part} <= {1000}
    want = [r[0] for r in sorted((r for r in rows if r[1] == "hot"), key=lambda r: (-r[2], r[0]))]
    assert seen == want
    after = (F.col("value") < 500)
    keyset = analytics.page_after(df.where("key = 'hot'"), ["key"], order, after, 10).collect()
    assert [r.id for r in sorted(keyset, key=lambda r: r.position)] == [r[0] for r in sorted((r for r in rows if r[1] == "hot" and r[2] < 500), key=lambda r: (-r[2], r[0]))][:10]
    assert analytics.clamp_page(0, 500) == (1, 100)
    assert analytics.clamp_page(3, 0) == (3, 1)


def test_session_exports_as_ordered_lines(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, 7, m, start + dt.timedelta(minutes=m // 3), "user", f"text {m}") for m in range(250)] + [(1, 8, 900, start.replace(microsecond=5), "assistant", "one")]
    random.Random(1).shuffle(rows)
    messages = spark.createDataFrame(rows, "tenant_id bigint, session_id bigint, message_id bigint, created_at timestamp_ntz, sender_type string, content string")
    exported = transcripts.export_transcripts(messages)
    lines = {(r.session_id, r.position): r.line for r in exported.collect()}
    want = [f"[{r[3].isoformat()}] USER: {r[5]}" for r in sorted((r for r in rows if r[1] == 7), key=lambda r: (r[3], r[2]))]
    assert [lines[(7, p)] for p in range(1, 251)] == want and len(lines) == 251
    assert lines[(8, 1)] == "[2024-01-01T00:00:00.000005] ASSISTANT: one"
    transcripts.write_transcripts(exported, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 251
    assert {p.name for p in (tmp_path / "out").glob("tenant_id=*")} == {"tenant_id=1"}


def test_usage_totals_add_up(bindings):
    per_type = analytics.usage_by_type(bindings.usage, bindings.tenants)
    known = bindings.usage.join(bindings.tenants, "tenant_id", "left_semi")
    assert per_type.agg(F.sum("total_tokens")).first()[0] == known.agg(F.sum("total_tokens")).first()[0]


def test_release_deletes_intermediates_only(spark, monkeypatch):
    monkeypatch.setattr(session, "_WRITTEN", {})
    kept = session.shared_dir(spark, "kept")
    spark.range(5).write.parquet(kept)
    written = session.materialize(spark.range(7), "scratch")
    folder = os.path.dirname(written.inputFiles()[0].removeprefix("file://"))
    assert written.count() == 7 and os.path.isdir(folder)
    session.release(spark)
    assert not os.path.exists(folder) and spark.read.parquet(kept).count() == 5


def test_clusters_must_name_a_shared_folder(spark, monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(ValueError):
        session.shared_dir(Cluster, "x")
