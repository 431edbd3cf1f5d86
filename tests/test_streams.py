"""Streams over several micro-batches against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parley.operators.analytics import quota_first_hit
from parley.session import shared_dir
from parley.streaming import sink
from parley.streaming.idle import idle_sessions
from parley.streaming.quota import quota_monitor, read_quota
from parley.streaming.usage import usage_rollup

MESSAGE = "message_id bigint, session_id bigint, tenant_id bigint, sender_type string, content string, created_at timestamp_ntz"
START = dt.datetime(2024, 1, 31, 20)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out, at = [], START
    for i in range(600):
        at += dt.timedelta(seconds=rng.choice([1, 2, 4, 30, 90, 130]))
        out.append((i, rng.randrange(12), 1 if i % 3 == 0 else 2, rng.choice(["user", "user", "assistant"]), "x", at))
    return [(m, s + 100 * t, t, k, c, a) for m, s, t, k, c, a in out]


def in_batches(spark, rows, schema, n):
    path = shared_dir(spark, "input")
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def tenants(spark):
    return spark.createDataFrame([(1, 120, 40), (2, 3, 0)], "tenant_id bigint, idle_rating_wait_seconds int, monthly_message_limit int")


def test_idle_stream_equals_batch(spark, rows, tenants):
    ratings = spark.createDataFrame([(105,), (207,)], "session_id bigint")
    path = shared_dir(spark, "idle")
    sink.drain(idle_sessions(in_batches(spark, rows, MESSAGE, 4), tenants, ratings), path, "append")
    streamed = {tuple(r) for r in spark.read.parquet(path).drop("batch_id").collect()}
    batch = {tuple(r) for r in idle_sessions(spark.createDataFrame(rows, MESSAGE), tenants, ratings).collect()}
    seen = max(r[5] for r in rows if r[3] == "user") - dt.timedelta(minutes=10)
    assert streamed == {r for r in batch if r[3] <= seen}
    assert streamed and not {r for r in batch if r[1] in (105, 207)}
    waits = {1: 120, 2: 5}
    assert all(r[3] - r[2] == dt.timedelta(seconds=waits[r[0]]) for r in batch)


def test_quota_monitor_over_batches(spark, rows, tenants):
    sessions = spark.createDataFrame([(s, None if s % 5 == 0 else f"v{s}") for s in sorted({r[1] for r in rows})], "session_id bigint, visitor_id string")
    path = shared_dir(spark, "quota")
    stream = in_batches(spark, rows, MESSAGE, 5)
    quota_monitor(stream, sessions, tenants, path, shared_dir(spark, "state"), availableNow=True).awaitTermination()
    cols = ["tenant_id", "month_start", "message_limit", "monthly_messages", "limit_hit_at"]
    got = {tuple(r) for r in read_quota(spark, path).select(*cols).collect()}
    batch = quota_first_hit(spark.createDataFrame(rows, MESSAGE), sessions, tenants)
    assert got == {tuple(r) for r in batch.select(*cols).collect()}
    assert any(r[4] for r in got) and any(r[4] is None for r in got)


def test_usage_rollup_over_batches(spark):
    rng = random.Random(1)
    usage = [(rng.randrange(3), rng.choice(["a", "b"]), rng.randrange(9), rng.randrange(9), rng.randrange(9), START + dt.timedelta(minutes=i)) for i in range(200)]
    schema = "tenant_id bigint, usage_type string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, created_at timestamp_ntz"
    path = shared_dir(spark, "usage")
    sink.drain(usage_rollup(in_batches(spark, usage, schema, 4)), path, "update")
    got = {tuple(r) for r in sink.read_latest(spark, path, ["tenant_id", "usage_type"]).select("tenant_id", "usage_type", "prompt_tokens", "completion_tokens", "total_tokens").collect()}
    assert got == {tuple(r) for r in usage_rollup(spark.createDataFrame(usage, schema)).collect()}
    tumbling = usage_rollup(spark.createDataFrame(usage, schema), window="1 hour")
    assert tumbling.agg(F.sum("total_tokens")).first()[0] == sum(u[4] for u in usage)
