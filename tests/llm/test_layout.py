"""Mixing, resharding, fixity and the pipeline."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from parley.llm import fixity, mixing, queries, resharding
from tests.conftest import SMALL
from tests.llm import tables


def quotients(votes, seats, caps):
    out = [0] * len(votes)
    for _ in range(seats):
        best = max((i for i in range(len(votes)) if out[i] < caps[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * out[i] + 1), -i), default=None)
        if best is None:
            break
        out[best] += 1
    return out


@pytest.mark.parametrize("seed", range(30))
def test_apportionment_is_by_highest_quotients(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 12))
    votes = rng.integers(0, 50, n) if seed % 3 else np.full(n, 7)
    caps = rng.integers(0, 40, n) if seed % 2 else np.full(n, 10**6)
    seats = int(rng.integers(0, 120))
    assert mixing.apportion(votes, seats, caps).tolist() == quotients(votes.tolist(), seats, caps.tolist())


def test_targets_stop_at_three_times_the_source():
    target = mixing.fill(np.array([10, 1000, 1000, 0]), np.array([5.0, 2.0, 1.0, 5.0]), 1.0, 3)
    assert target[0] == 30 and target[3] == 0
    assert target[1:3].tolist() == pytest.approx([1980 * 2 / 3, 1980 / 3])


def test_mix(spark):
    docs = tables.documents(spark, SMALL)
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    size = {i: len(tables.WORD.findall(t or "")) for i, t in tables.rows_of(docs)}
    source = defaultdict(int)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] and 0 <= r["copies"] <= 3
        source[r["source"]] += r["taken"]
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(sum(size.values()))
    for name, target in {r["source"]: r["target"] for r in got}.items():
        assert abs(source[name] - target) <= max(0.03 * target, 10)


def test_mix_of_awkward_rows(spark):
    docs = tables.frame(spark, tables.awkward())
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(tables.awkward())
    by_source = {r["source"]: (r["source_size"], r["target"], r["size"]) for r in got}
    assert set(by_source) == {"s1", "s2", "s3", None}
    assert all(r["taken"] == 0 for r in got if not r["size"])
    taken = mixing.take_documents(docs, mixing.mix_sources(docs))
    assert taken.columns == docs.columns
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in got}
    assert Counter(r["doc_id"] for r in taken.collect())[7] == copies[7, 30_000]
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs.where("doc_id in (4, 5)")).select(F.sum("taken")).first()[0] == 0


def test_flow_moves_the_fewest():
    rng = np.random.default_rng(4)
    for _ in range(20):
        supply = rng.integers(0, 6, 3).tolist()
        demand = resharding.even(sum(supply), 3)
        flow = resharding.cheapest_flow(supply, demand, lambda i, j: int(i != j))
        assert [sum(flow.get((i, j), 0) for j in range(3)) for i in range(3)] == supply
        assert [sum(flow.get((i, j), 0) for i in range(3)) for j in range(3)] == demand
        assert sum(x for (i, j), x in flow.items() if i != j) == sum(max(0, s - d) for s, d in zip(supply, demand))


def test_flow_at_other_costs():
    cost = [[4, 1, 3], [2, 0, 5]]
    flow = resharding.cheapest_flow([3, 4], [3, 2, 2], lambda i, j: cost[i][j])
    best = min(
        sum(cost[0][j] * x[j] + cost[1][j] * (d - x[j]) for j, d in enumerate((3, 2, 2)))
        for x in itertools.product(range(4), range(3), range(3))
        if sum(x) == 3
    )
    assert sum(cost[i][j] * x for (i, j), x in flow.items()) == best


def slots_are_gapless(rows):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_reshard(spark):
    docs = tables.documents(spark, "/root/testdata/sf0.01")
    got = queries.op6_reshard(spark, "/root/testdata/sf0.01").collect()
    texts = dict(tables.rows_of(docs))
    held = Counter()
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        held[r["shard"]] += r["size"]
    assert sorted(held) == list(range(8)) and len(got) == len(texts)
    assert max(held.values()) - min(held.values()) < 0.03 * sum(held.values()) / 8
    slots_are_gapless(got)
    old = Counter()
    for r in got:
        old[r["old_shard"]] += r["size"]
    moved = sum(r["size"] for r in got if r["shard"] != r["old_shard"])
    capacity = sum(held.values()) / 8
    assert moved <= sum(max(0, s - capacity) for s in old.values()) + 0.02 * sum(held.values())


def test_reshard_of_awkward_rows(spark):
    rows = [r for r in tables.awkward() for _ in range(3)]
    docs = tables.frame(spark, rows)
    got = resharding.reshard(docs, 4, F.col("n_chars") % 3).collect()
    assert len(got) == len(rows)
    slots_are_gapless(got)
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 4} == {(1, 0)}
    assert resharding.reshard(docs.limit(0), 4, F.lit(0)).count() == 0


def test_rewrite_touches_affected_shards_only(spark, tmp_path):
    docs = tables.documents(spark, SMALL)
    path = str(tmp_path / "shards")
    old = F.when(F.col("source") == "src0", 3).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(2))).cast("int")
    docs.withColumn("shard", old).withColumn("old_shard", old).write.partitionBy("shard").parquet(path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "shards").glob("shard=*/*.parquet")}
    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    kept = docs.where(F.col("source") == "src0").agg(F.sum(F.octet_length("text") + 1)).first()[0]
    capacities = lambda _: [(total - kept) // 2 - 40_000, (total - kept) - ((total - kept) // 2 - 40_000), 0, kept]
    placed = resharding.reshard(docs, 4, old, capacities)
    located = docs.join(placed.select("doc_id", "old_shard", "shard"), "doc_id")
    resharding.rewrite_affected(located, path)
    after = spark.read.parquet(path)
    assert after.count() == docs.count()
    assert {(r["doc_id"], r["shard"]) for r in after.collect()} == {(r["doc_id"], r["shard"]) for r in placed.collect()}
    untouched = [p for p in before if p.parent.name == "shard=3"]
    assert untouched and all(p.exists() and p.stat().st_mtime_ns == before[p] for p in untouched)


def test_rewrite_to_fewer_shards_leaves_every_document_in_one(spark, tmp_path):
    """Ten shards become eight: the folders of the last two go with their last document."""
    docs = tables.documents(spark, SMALL)
    path = str(tmp_path / "shards")
    old = F.pmod(F.xxhash64("doc_id"), F.lit(10)).cast("int")
    docs.withColumn("shard", old).withColumn("old_shard", old).write.partitionBy("shard").parquet(path)
    located = docs.join(resharding.reshard(docs, 8, old).select("doc_id", "old_shard", "shard"), "doc_id")
    for _ in range(2):  # a repeated run changes nothing
        resharding.rewrite_affected(located, path)
        after = spark.read.parquet(path).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("shard").alias("shard")).collect()
        assert len(after) == docs.count() and {r["n"] for r in after} == {1}
        assert {r["shard"] for r in after} == set(range(8))
        assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == [f"shard={i}" for i in range(8)]


PAGES = "page_id long, url string, html string"


def test_fixity_of_equal_and_damaged_replicas(spark):
    rows = [(i, f"u{i}", f"<p>{i}</p>" * (i % 5)) for i in range(300)]
    pages = spark.createDataFrame(rows, PAGES)
    assert fixity.compare(pages, pages.repartition(5), file_records=64, fanout=4).count() == 0
    damaged = {5: None, 70: "x", 71: None, 299: ""}
    other = spark.createDataFrame([(i, u, damaged.get(i) or h) for i, u, h in rows if damaged.get(i, 1) is not None] + [(1000, "n", "new")], PAGES)
    got = {(r["page_id"], r["kind"]) for r in fixity.compare(pages, other, file_records=64, fanout=4).collect()}
    assert got == {(5, "missing"), (70, "changed"), (71, "missing"), (1000, "extra")}
    offsets = {r["page_id"]: (r["offset"], r["length"]) for r in fixity.compare(pages, other.limit(0), file_records=64, fanout=4).collect()}
    record = lambda r: spark.createDataFrame([r], PAGES).select(fixity.warc_record(F.col("url"), F.col("page_id"), F.col("html"))).first()[0]
    start = 0
    for r in rows[:3]:
        raw = bytes(record(r))
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and r[2].encode() in raw
        assert offsets[r[0]] == (start, len(raw))
        start += len(raw)


def test_fixity_of_awkward_pages(spark):
    rows = [(None, "a", "x"), (None, None, None), (1, None, "y"), (1, "b", "z"), (1, "b", "z"), (-3, "", "")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("slot", F.lit("clash")).withColumn("file", F.lit(1))
    assert fixity.compare(pages, pages).count() == 0
    assert fixity.compare(pages.limit(0), pages.limit(0)).count() == 0
    fewer = pages.where("not (page_id <=> 1 and url is null)")
    assert {(r["page_id"], r["kind"]) for r in fixity.compare(pages, fewer).collect()} == {(1, "changed")}


def test_pipeline_beside_its_stages(spark):
    """Every stage returns the columns of documents and keeps clean documents; the result is that of its operators in turn."""
    docs = tables.documents(spark, SMALL)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SMALL).collect(), docs.schema)
        assert kept.columns == docs.columns, name
        counts.append(kept.count())
    ids = {r["doc_id"] for r in kept.collect()}
    assert not any(labels.get(i) == 0 for i in ids) or sum(labels.get(i) == 0 for i in ids) <= 2
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
    want = sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in last.collect())
    got = sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in entry_point.queries()["pipeline"](spark, SMALL).collect())
    assert got == want and len(got) == counts[-1]


def test_pipeline_stages_of_awkward_rows(spark, tmp_path):
    import shutil

    for name in ("labels", "benchmark"):
        shutil.copy(f"{SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.createDataFrame(tables.awkward(), tables.SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr).count(9) <= 1


def test_pipeline_rows_of_one_id_stand_by_their_own_text(spark, tmp_path):
    """Rows without id, and of a repeated id, neither fall with another row nor stand for it."""
    leak = tables.sentence(500, 30)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = {i: tables.sentence(i, 60) for i in range(600, 606)}
    rows = [(None, texts[600]), (None, texts[601] + " " + leak), (None, texts[602]), (None, texts[602]), (3, texts[603]), (3, texts[604]), (3, texts[604]), (3, texts[605] + " " + leak), (4, texts[600]), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], tables.SCHEMA)
    of = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    assert of(clean) == sorted((r for r in rows if leak not in (r[1] or "")), key=repr)
    want = [(4, texts[600]), *rows[1:3], *rows[4:6], rows[7], *rows[9:]]
    assert of(corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))) == sorted(want, key=repr)


def test_pipeline_rejects_by_text(spark, tmp_path):
    """Of rows without id those stay whose text is good."""
    good, bad = [tables.sentence(i, 80) for i in range(40)], ["!!! ### " * (20 + i) for i in range(40)]
    labelled = [(i, t) for i, t in enumerate(good + bad)]
    spark.createDataFrame([(i, int(i < 40)) for i, _ in labelled], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [*labelled, *((None, t) for t in good[:3] + bad[:3])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], tables.SCHEMA)
    kept = corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).where("doc_id is null").collect()
    assert sorted(r["text"] for r in kept) == sorted(good[:3])
