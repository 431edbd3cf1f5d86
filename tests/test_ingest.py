"""Ingestion and the vector collection."""

import os

import pytest
from pyspark.sql import functions as F

from parley.operators import ingest
from parley.session import shared_dir
from parley.sources import cms, events, vectors

DOC = "tenant_id bigint, seq bigint, point_id string, title string, content string, url string, source string, source_type string"


def docs(spark, n=40, tenant=None, kind="primary", mark=""):
    rows = [(tenant or i % 3, i, f"p{i}", f"t{i}{mark}", f"word{i} text", "u", "s", kind) for i in range(n)]
    return spark.createDataFrame(rows, DOC)


def test_rerun_changes_nothing(spark):
    path = shared_dir(spark, "t")
    ingest.run(docs(spark), path, "r1")
    first = sorted(map(str, vectors.read_vectors(spark, path).collect()))
    ingest.run(docs(spark), path, "r2")
    assert sorted(map(str, vectors.read_vectors(spark, path).collect())) == first and len(first) == 40


def test_upsert_replaces_only_touched_partitions(spark):
    path = shared_dir(spark, "t")
    vectors.upsert_vectors(docs(spark), path)
    vectors.upsert_vectors(docs(spark, 5, tenant=1, mark="!").unionByName(docs(spark, 5, tenant=1, mark="?").withColumn("seq", F.col("seq") + 10)), path)
    left = vectors.read_vectors(spark, path)
    assert left.where("tenant_id <> 1").count() == 27
    one = left.where("tenant_id = 1").collect()
    assert sorted(r.title for r in one) == sorted(f"t{i}?" for i in range(5))
    assert os.path.isdir(f"{path}/tenant_id=1/source_type=primary")


def test_failing_document_fails_alone(spark):
    good = ingest.hashing_embedder(8)

    def fragile(texts):
        if any("word7 " in t for t in texts):
            raise RuntimeError("maximum context length")
        return good(texts)

    status = {r.point_id: r.status for r in ingest.embed(docs(spark), fragile).collect()}
    assert {p for p, s in status.items() if s == "failed"} == {"p7"}


def test_long_document_passes_on_the_harder_cut(spark):
    good = ingest.hashing_embedder(8)

    def limited(texts):
        if any(len(t) > 7000 for t in texts):
            raise RuntimeError("maximum context length")
        return good(texts)

    rows = [(1, 1, "p", "t", "word " * 9000, "u", "s", "primary"), (1, 2, "q", "", "", "u", "s", "primary")]
    got = {r.point_id: (r.status, r.embedding) for r in ingest.embed(spark.createDataFrame(rows, DOC), limited).collect()}
    assert got["p"][0] == "succeeded" and abs(sum(x * x for x in got["p"][1]) - 1) < 1e-5
    assert got["q"][0] == "failed"


def test_reindex_writes_a_job_row_per_tenant(spark):
    path, jobs = shared_dir(spark, "t"), shared_dir(spark, "jobs")
    tenants = spark.createDataFrame([(0,), (1,), (2,), (9,)], "tenant_id bigint")
    ingest.reindex(docs(spark), path, jobs, "r1", tenants)
    rows = {r.tenant_id: (r.status, r.total, r.succeeded) for r in spark.read.parquet(jobs).collect()}
    assert rows == {0: ("completed", 14, 14), 1: ("completed", 13, 13), 2: ("completed", 13, 13), 9: ("completed", 0, 0)}
    broken = docs(spark).withColumn("title", F.raise_error(F.lit("source is gone")).cast("string"))
    ingest.reindex(broken, path, jobs, "r2", tenants)
    failed = spark.read.parquet(jobs).where("run_id = 'r2'").collect()
    assert {r.status for r in failed} == {"failed"} and all("source is gone" in r.error for r in failed)
    assert vectors.read_vectors(spark, path).count() == 40


def test_pending_skips_finished_documents(spark):
    done = docs(spark, 30)
    assert ingest.pending(docs(spark, 40), done).count() == 10


def test_post_scan_reads_cms_tables(spark):
    root = shared_dir(spark, "cms")
    posts = spark.createDataFrame(
        [(1, "T", "<b>x</b>", "post", "publish", "s"), (2, "T", "", "post", "publish", "s"), (3, "T", "y", "post", "draft", "s")],
        "ID bigint, post_title string, post_content string, post_type string, post_status string, post_name string",
    ).withColumn("post_date", F.lit("2024-01-01").cast("timestamp_ntz"))
    posts.write.parquet(f"{root}/wp_posts")
    scanned = cms.scan_posts(cms.read_posts(spark, {"path": root}))
    assert [r.id for r in scanned.collect()] == [1]
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(post_status,publish)" in plan and "post_status" in plan.split("PushedFilters")[1]


@pytest.mark.parametrize("value, json", [('{"k": 1}', True), ("plain", False), ("12", True), (None, False)])
def test_history_decodes_json(spark, value, json):
    rows = spark.createDataFrame([(1, value)], "session_no bigint, bot_response_source string").withColumn("event_timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = events.event_history(rows, rows).select(F.col("source_json").isNotNull().alias("j"), "source_text").first()
    assert got.j is json and got.source_text == (None if json else value)


def test_partition_whose_documents_all_fail_is_emptied(spark):
    path, jobs, usage = (shared_dir(spark, x) for x in ("t", "jobs", "usage"))
    ingest.run(docs(spark), path, "r1")
    good = ingest.hashing_embedder(8)

    def fails_for_second(texts):
        if any("broken" in t for t in texts):
            raise RuntimeError("no")
        return good(texts)

    mixed = docs(spark).withColumn("title", F.when(F.col("tenant_id") == 1, "broken").otherwise(F.col("title")))
    tenants = spark.createDataFrame([(0,), (1,), (2,)], "tenant_id bigint")
    ingest.reindex(mixed, path, jobs, "r2", tenants, fails_for_second, usage)
    assert {r.tenant_id: r.status for r in spark.read.parquet(jobs).collect()} == {0: "completed", 1: "failed", 2: "completed"}
    left = vectors.read_vectors(spark, path)
    assert left.where("tenant_id = 1").count() == 0 and left.count() == 27
    assert {r.tenant_id: r.total_tokens for r in spark.read.parquet(usage).collect()} == {0: 42, 2: 39}
