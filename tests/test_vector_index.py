"""Approximate search against the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import retrieval as rt
from parley.operators.vector_index import HyperplaneIndex, recall

POINTS = "vec_id bigint, tenant_id bigint, source_type string, embedding array<float>"
QUERIES = "query_id bigint, tenant_id bigint, qe array<float>"


@pytest.fixture(scope="module")
def clustered(spark):
    """Families of near vectors: most of a tenant's points are no candidates of a query."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 24))
    vectors = [(i, i % 2, "external" if i % 5 == 0 else "primary", (centres[i % 300] + 0.3 * rng.normal(size=24)).tolist()) for i in range(6000)]
    asked = [(q, q % 3, (centres[q % 300] + 0.3 * rng.normal(size=24)).tolist()) for q in range(400)]
    return spark.createDataFrame(asked, QUERIES), spark.createDataFrame(vectors, POINTS)


def rows(df):
    return sorted((r.query_id, r.tenant_id, r.source_type, r.vec_id, r.score) for r in df.collect())


def test_recall_and_candidates(spark, clustered):
    asked, vectors = clustered
    index = HyperplaneIndex(tables=8, cell_rows=40, crossed=2)
    built = index.build(vectors)
    exact = rt.bucket_topk(asked, vectors, k=5)
    found = index.topk(asked, built, k=5)
    assert recall(found, exact).first().recall >= 0.9
    scores = {(r[0], r[2], r[3]): r[4] for r in rows(rt.bucket_topk(asked, vectors, k=6000))}
    assert all(scores[(q, s, v)] == score for q, _, s, v, score in rows(found))  # scores are exact
    cells = built.select("tenant_id", "source_type", F.explode("cells").alias("cell")).groupBy("tenant_id", "source_type", "cell").count()
    assert cells.agg(F.max("count")).first()[0] < 1000


def test_small_collections_are_exact(spark, clustered):
    asked, vectors = clustered
    index = HyperplaneIndex(tables=1, cell_rows=1200, crossed=2)  # up to 2 hyperplanes, both crossed
    assert rows(index.topk(asked, index.build(vectors), k=4, floor=0.2)) == rows(rt.bucket_topk(asked, vectors, k=4, floor=0.2))


def test_added_points_are_found(spark, clustered, tmp_path):
    asked, vectors = clustered
    index = HyperplaneIndex(tables=2, cell_rows=600, crossed=4)
    path = str(tmp_path / "index")
    index.build(vectors.where("vec_id < 5000")).write.parquet(path)
    old = spark.read.parquet(path)
    index.add(old, vectors.where("vec_id >= 5000")).write.mode("append").parquet(path)
    whole = spark.read.parquet(path)
    assert whole.count() == 6000
    assert whole.groupBy("tenant_id", "source_type").agg(F.count_distinct("bits").alias("n")).where("n > 1").isEmpty()
    assert rows(index.topk(asked, whole, k=3)) == rows(rt.bucket_topk(asked, vectors, k=3))


def test_awkward_rows(spark):
    index = HyperplaneIndex(tables=2, cell_rows=1, crossed=1)
    vectors = spark.createDataFrame([(1, 1, "primary", [0.0, 0.0]), (2, 1, "primary", [1.0, 0.0]), (3, 1, "primary", None), (4, 1, "primary", [1.0, 0.0])], POINTS)
    asked = spark.createDataFrame([(1, 1, [1.0, 0.1]), (2, 1, None), (3, 9, [1.0, 0.0])], QUERIES)
    got = rows(index.topk(asked, index.build(vectors), k=3))
    assert [(r[0], r[3]) for r in got] == [(1, 2), (1, 4)]  # no zero vector, no missing one
    assert rows(index.topk(asked.limit(0), index.build(vectors))) == rows(index.topk(asked, index.build(vectors.limit(0)))) == []


@pytest.mark.parametrize("bad", [{"tables": 0}, {"cell_rows": 0}, {"crossed": -1}])
def test_arguments(bad):
    with pytest.raises(ValueError):
        HyperplaneIndex(**bad)


def test_recall_of_all_user_messages(spark, bindings):
    from parley.plans.retrieval_queries import APPROXIMATE

    asked, vectors = bindings.query_vectors, bindings.vectors
    measured = recall(APPROXIMATE.topk(asked, APPROXIMATE.build(vectors), k=5), rt.bucket_topk(asked, vectors, k=5)).first()
    assert measured.wanted > 0 and measured.recall >= 0.9
