"""Retrieval against brute force, with blocks small enough that every tenant needs several."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import retrieval as rt


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    vectors = []
    for i in range(400):
        tenant = 1 if i % 3 == 0 else int(rng.integers(2, 6))
        vector = base[i % 40] if i % 7 else rng.normal(size=8)  # many exact copies: ties
        vectors.append((i, tenant, "primary" if i % 2 else "external", [float(x) for x in vector]))
    vectors.append((400, 1, "primary", [0.0] * 8))
    queries = [(q, int(rng.integers(1, 7)), [float(x) for x in (base[q % 40] + rng.normal(size=8) * 0.3)]) for q in range(60)]
    return queries, vectors


def brute(queries, vectors, k, types=("primary", "external"), floor=None):
    out = {}
    for qid, tenant, q in queries:
        for kind in types:
            hits = []
            for vid, t, source, v in vectors:
                norm = np.linalg.norm(q) * np.linalg.norm(v)
                if t == tenant and source == kind and norm > 0:
                    score = float((np.asarray(q) * np.asarray(v)).sum() / norm)
                    if floor is None or score >= floor:
                        hits.append((-score, vid))
            for rank, (score, vid) in enumerate(sorted(hits)[:k], 1):
                out[(qid, kind, rank)] = (vid, -score)
    return out


def frames(spark, data):
    return (
        spark.createDataFrame(data[0], "query_id bigint, tenant_id bigint, qe array<float>"),
        spark.createDataFrame(data[1], "vec_id bigint, tenant_id bigint, source_type string, embedding array<float>"),
    )


def as_float32(data):
    cast = lambda rows: [(*r[:-1], np.asarray(r[-1], dtype=np.float32).astype(float)) for r in rows]
    return cast(data[0]), cast(data[1])


@pytest.mark.parametrize("blocks", [(8_192, 1_024), (16, 5)])
@pytest.mark.parametrize("floor", [None, 0.4])
def test_bucket_topk(spark, data, monkeypatch, blocks, floor):
    monkeypatch.setattr(rt, "VECTOR_BLOCK", blocks[0])
    monkeypatch.setattr(rt, "QUERY_BLOCK", blocks[1])
    got = {(r.query_id, r.source_type, r.rank): (r.vec_id, r.score) for r in rt.bucket_topk(*frames(spark, data), k=3, floor=floor).collect()}
    want = brute(*as_float32(data), 3, floor=floor)
    assert got.keys() == want.keys()
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_few_pairs_of_a_block_are_compared_exactly():
    """All best pairs are among those looked at, which are few beside all, however many vectors are equal or have no direction."""
    rng = np.random.default_rng(5)
    left, right = rng.normal(size=(600, 16)), rng.normal(size=(5000, 16))
    right[100:110], right[7] = right[100], 0
    (left, a, asked), (right, b, points) = rt._directed(left), rt._directed(right)
    assert len(asked) == 600 and 7 not in points and len(points) == 4999
    tiles = [(i, j) for _, i, j in rt._near(left, a, right, b, 3)]
    seen = set(zip(np.concatenate([i for i, _ in tiles]).tolist(), np.concatenate([j for _, j in tiles]).tolist()))
    best = np.argsort(-(left @ right.T) / (a[:, None] * b[None, :]), axis=1, kind="stable")[:, :3]
    assert {(i, j) for i in range(600) for j in best[i].tolist()} <= seen
    assert len(seen) < 600 * 20


def test_two_bucket(spark, data):
    queries, vectors = frames(spark, data)
    got = {}
    for r in rt.two_bucket(queries, vectors, 3).collect():
        got.setdefault(r.query_id, []).append((r.position, r.source_type, r.vec_id))
    top = brute(*as_float32(data), 3)
    blended = 0
    for qid, _, _ in data[0]:
        lists = {kind: [(*top[(qid, kind, n)], n) for n in range(1, 4) if (qid, kind, n) in top] for kind in ("primary", "external")}
        hits = [(-s, 0, n, v, "primary") for v, s, n in lists["primary"]]
        if len(hits) < 3 or max([-h[0] for h in hits] + [0]) < 0.7:
            blended += 1
            hits += [(-s, 1, n, v, "external") for v, s, n in lists["external"]]
        want = [(i, h[4], h[3]) for i, h in enumerate(sorted(hits)[:3], 1)]
        assert sorted(got.get(qid, [])) == want
    assert 0 < blended < len(data[0])


def test_rerank_is_sorted_and_short(spark, data):
    queries, vectors = frames(spark, data)
    both = rt.union_rerank(queries, vectors, 3).collect()
    for qid in {r.query_id for r in both}:
        scores = [r.score for r in sorted((r for r in both if r.query_id == qid), key=lambda r: r.position)]
        assert scores == sorted(scores, reverse=True) and len(scores) <= 3


def test_block_of_copies_keeps_k_rows_per_query(spark):
    vectors = spark.createDataFrame([(i, 1, "primary", [1.0, 2.0]) for i in range(3000)], "vec_id bigint, tenant_id bigint, source_type string, embedding array<float>")
    queries = spark.createDataFrame([(q, 1, [float(q), 1.0]) for q in range(20)], "query_id bigint, tenant_id bigint, qe array<float>")
    got = rt.bucket_topk(queries, vectors, 3).collect()
    assert len(got) == 60 and {r.vec_id for r in got} == {0, 1, 2}


def model_pack(texts, budget):
    def cut(t, n):
        head = int(n * 0.8)
        return t if len(t) <= n else t[:head] + "\n...[content truncated]...\n" + t[-(n - head):]

    share = budget // max(len(texts), 1)
    parts = [cut(t, share) for t in texts]
    total = sum(map(len, parts))
    if total > budget:
        parts = [cut(t, max(int(share * (budget / total)), 500)) for t in texts]
    return "\n\n---\n\n".join(parts)


def test_pack_context(spark):
    groups = {1: ["a" * 3000, "b" * 2500, "c" * 100], 2: ["d" * 20], 3: ["e" * 9000], 4: ["f" * 900, "g" * 901, "h" * 899]}
    rows = [(q, i, t) for q, texts in groups.items() for i, t in enumerate(texts, 1)]
    got = rt.pack_context(spark.createDataFrame(rows, "query_id bigint, position bigint, context string"), 2700)
    assert {r.query_id: r.context for r in got.collect()} == {q: model_pack(t, 2700) for q, t in groups.items()}


def test_citations_and_confidence(spark):
    hits = spark.createDataFrame(
        [(1, 1, 0.9, "https://a.example.com/x", "t" * 300, "s"), (1, 2, 0.5, "www.x/y", "short", "s"), (2, 1, 0.8, "", "u", "s"), (2, 2, 0.4, None, "u", "s"), (3, 1, 0.2, "https://z.example.com", "u", "s")],
        "query_id bigint, position bigint, score double, url string, content string, source string",
    )
    kept = rt.min_score(hits)
    cited = rt.citations(kept)
    rows = {(r.query_id, r.position): (r.url, r.snippet) for r in cited.collect()}
    assert rows == {(1, 1): ("https://a.example.com/x", "t" * 200 + "..."), (1, 2): (":///", "short...")}
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint")
    found = cited.groupBy("query_id").agg(F.max("score").alias("best"))
    assert {r.query_id: r.confidence for r in rt.answer_confidence(queries, found).collect()} == {1: 0.9, 2: 0.0, 3: 0.0}
    spare = {r.position: r.url for r in rt.citations(kept, F.lit("https://f.example.com/")).where("query_id = 2").collect()}
    assert spare == {1: "https://f.example.com/", 2: "https://f.example.com/"}


def test_tenants_with_equal_ids_and_types_of_their_own(spark):
    """Ids repeat over tenants; each searches its own source type and sees its own payload and fallback only."""
    points = [
        (1, 1, "docs", [1.0, 0.0], "text of one", ""),
        (1, 2, "primary", [1.0, 0.0], "text of two", "https://two.example.com/a"),
        (1, 2, "docs", [1.0, 0.0], "not its type", "https://two.example.com/b"),
        (2, 1, "external", [0.6, 0.8], "outside", "https://out.example.com/x"),
    ]
    vectors = spark.createDataFrame(points, "vec_id bigint, tenant_id bigint, source_type string, embedding array<double>, content string, url string")
    queries = spark.createDataFrame([(10, 1, [1.0, 0.0]), (20, 2, [1.0, 0.0])], "query_id bigint, tenant_id bigint, qe array<double>")
    tags = spark.createDataFrame([(1, "docs", "https://one.example.com/")], "tenant_id bigint, source_type string, fallback_url string")
    hits = rt.with_payload(rt.two_bucket(queries, vectors, 3, tags), vectors, "url", "content")
    got = {(r.query_id, r.position): (r.source_type, r.content) for r in hits.collect()}
    assert got == {(10, 1): ("docs", "text of one"), (10, 2): ("external", "outside"), (20, 1): ("primary", "text of two")}
    cited = rt.citations(rt.with_fallback(hits, tags), F.col("fallback_url"))
    assert {(r.query_id, r.position): r.url for r in cited.collect()} == {
        (10, 1): "https://one.example.com/", (10, 2): "https://out.example.com/x", (20, 1): "https://two.example.com/a",
    }


def test_floor_looks_at_the_whole_score(spark):
    y = float(np.sqrt(1 - 0.2999997**2))
    vectors = spark.createDataFrame([(1, 1, "primary", [0.2999997, y])], "vec_id bigint, tenant_id bigint, source_type string, embedding array<double>")
    queries = spark.createDataFrame([(1, 1, [1.0, 0.0])], "query_id bigint, tenant_id bigint, qe array<double>")
    assert rt.min_score(rt.two_bucket(queries, vectors)).count() == 0
