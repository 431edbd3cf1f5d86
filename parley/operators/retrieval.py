"""Cosine retrieval over tenant collections and the answer context built from it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text, urls
from parley.operators.groups import lookup, slice_mask, spread_slices, top_per_group, with_slice

# Fixed values
TOP_K = 3
BLEND_BELOW = 0.7
SCORE_FLOOR = 0.3
CONTEXT_CHARS = 14_000
CONTEXT_FLOOR = 500
SEPARATOR = "\n\n---\n\n"
PRIMARY, EXTERNAL = "primary", "external"
SYSTEM_PROMPT = (
    "You are a helpful assistant for {brand}. Use only the provided context snippets to answer; "
    "if the context does not contain the answer, say so briefly and suggest checking the website or contacting the team."
    "{site} "
    "Keep responses concise and under 250 characters when a short reply suffices."
)
SITE_CLAUSE = " Official website (for grounding references only): {site}."

#: Rows of one block of the product; 8192 x 1024 doubles are 64 MB.
VECTOR_BLOCK = 8_192
QUERY_BLOCK = 8_192
#: Queries multiplied at a time, columns that share a maximum, and numbers of vectors compared exactly at a time.
_TILE = 256
_GROUP = 64
_EXACT = 1 << 21
#: What a point is known by; ids repeat over tenants and source types.
POINT = ["tenant_id", "source_type", "vec_id"]
#: A product of unit vectors in single precision may differ from the exact cosine by so much for each dimension.
_PRODUCT_ERROR = 1.2e-7


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.astype(np.float64).reshape(len(column), -1))


def _directed(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have a direction, their lengths and numbers; zero vectors and those with non-finite components have none."""
    norm = np.sqrt((matrix * matrix).sum(axis=1))
    kept = np.flatnonzero((norm > 0) & np.isfinite(norm))
    return matrix[kept], norm[kept], kept


def _near(left: np.ndarray, left_norm: np.ndarray, right: np.ndarray, right_norm: np.ndarray, k: int):
    """Tiles ``(first row, rows, columns)`` of all pairs that may be among the ``k`` best of their row.

    Columns are taken in groups: the ``k``-th best of the groups' maxima is no more than
    the ``k``-th best cosine, so only groups that reach it are looked at column by column.
    """
    n, slack = len(right), _PRODUCT_ERROR * (left.shape[1] + 4)
    groups = -(-n // _GROUP)
    ours, theirs = (left / left_norm[:, None]).astype(np.float32), np.zeros((groups * _GROUP, right.shape[1]), dtype=np.float32)
    theirs[:n] = right / right_norm[:, None]
    for at in range(0, len(ours) if n else 0, _TILE):
        rough = ours[at : at + _TILE] @ theirs.T
        rough[:, n:] = -np.inf
        if groups <= k:
            i, j = np.divmod(np.arange(len(rough) * n), n)
        else:
            most = rough.reshape(len(rough), _GROUP, groups).max(axis=1)
            least = np.partition(most, groups - k, axis=1)[:, groups - k] - np.float32(slack)
            i, group = np.nonzero(most >= least[:, None])
            j = group[:, None] + groups * np.arange(_GROUP)[None, :]
            i, j = np.repeat(i, _GROUP), j.ravel()
            reached = rough[i, j] >= least[i]
            i, j = i[reached], j[reached]
        yield at, i + at, j


def _block_topk(k: int, floor: float | None):
    """Top ``k`` of a block of vectors for each query of a block, as an Arrow function of one grid cell."""

    def cell(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not len(queries) or not len(vectors):
            return pa.table({n: pa.array([], t) for n, t in (("query_id", queries["query_id"].type), ("vec_id", vectors["vec_id"].type), ("score", pa.float64()))}).append_column(
                "tenant_id", pa.array([], queries["q_tenant_id"].type)
            ).append_column("source_type", pa.array([], pa.string())).select(["query_id", *POINT, "score"])
        vectors = vectors.take(pa.array(np.argsort(vectors["vec_id"].to_numpy(), kind="stable")))  # the lower column wins a tie
        left, right = _matrix(queries["qe"]), _matrix(vectors["embedding"])
        (left, left_norm, asked), (right, right_norm, points) = _directed(left), _directed(right)
        rows, cols, scores = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0)]
        for at, i, j in _near(left, left_norm, right, right_norm, k):
            # pair by pair, so that equal vectors get equal scores
            step = max(_EXACT // left.shape[1], 1)
            exact = [(right[j[x : x + step]] * left[i[x : x + step]]).sum(axis=1) / (left_norm[i[x : x + step]] * right_norm[j[x : x + step]]) for x in range(0, len(i), step)]
            exact = np.concatenate([np.empty(0), *exact])
            best = np.lexsort((j, -exact, i))
            i, j, exact = i[best], j[best], exact[best]
            first = np.searchsorted(i, np.arange(at, at + _TILE))
            keep = np.arange(len(i)) - first[i - at] < k
            if floor is not None:
                keep &= exact >= floor
            rows.append(asked[i[keep]])
            cols.append(points[j[keep]])
            scores.append(exact[keep])
        rows, cols = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols))
        return pa.table(
            {
                "query_id": queries["query_id"].combine_chunks().take(rows),
                "tenant_id": queries["q_tenant_id"].combine_chunks().take(rows),
                "source_type": vectors["source_type"].combine_chunks().take(cols).cast(pa.string()),
                "vec_id": vectors["vec_id"].combine_chunks().take(cols),
                "score": pa.array(np.concatenate(scores)),
            }
        )

    return cell


def cell_topk(asked: DataFrame, points: DataFrame, asked_by: list[str], cell: list[str], k: int, floor: float | None = None, only: DataFrame | None = None) -> DataFrame:
    """Exact cosine top ``k`` of every query in every cell it asks, not merged over cells.

    ``points``: ``cell`` columns, vec_id, embedding.  ``asked``: ``asked_by`` columns
    (some or all of ``cell``, tenant_id among them), query_id, qe.  ``only`` names the
    cells to search.  Both sides of a cell are cut into blocks that follow its
    size, so a large cell becomes many tasks and none outgrows one.
    """
    types = {f.name: f.dataType.simpleString() for f in [*asked.schema, *points.schema]}
    points, asked = with_slice(points.select(*cell, "vec_id", "embedding"), "vec_id"), with_slice(asked.select(*asked_by, "query_id", "qe"), "query_id")
    n_points = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("nv"), slice_mask())
    if only is not None:
        n_points = n_points.join(only.select(*cell).distinct(), cell, "left_semi")
    n_asked = asked.groupBy(*asked_by).agg(F.count(F.lit(1)).alias("nq"), slice_mask())
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    sizes = [blocks("nv", VECTOR_BLOCK).alias("vector_blocks"), blocks("nq", QUERY_BLOCK).alias("query_blocks")]
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slot = lambda key, n: F.pmod(F.xxhash64(key, F.lit(1)), F.col(n)).cast("int")
    right_grid = n_points.join(n_asked.drop("_mask"), asked_by).select(*cell, "_mask", *sizes)
    left_grid = n_asked.join(n_points.drop("_mask"), asked_by).select(*cell, "_mask", *sizes)
    right = (
        points.join(spread_slices(right_grid), [*cell, "_slice"])
        .withColumn("vector_block", slot("vec_id", "vector_blocks"))
        .withColumn("query_block", upto("query_blocks"))
    )
    left = (
        asked.join(spread_slices(left_grid), [*asked_by, "_slice"])
        .withColumn("query_block", slot("query_id", "query_blocks"))
        .withColumn("vector_block", upto("vector_blocks"))
    )
    block = [*cell, "vector_block", "query_block"]
    right = right.select(*block, "vec_id", "embedding")
    # both sides carry columns of the same grid, so the query side gets names of its own
    left = left.select("query_id", "qe", *[F.col(c).alias(f"q_{c}") for c in block])
    schema = f"query_id {types['query_id']}, tenant_id {types['tenant_id']}, source_type string, vec_id {types['vec_id']}, score double"
    return left.groupBy(*[f"q_{c}" for c in block]).cogroup(right.groupBy(*block)).applyInArrow(_block_topk(k, floor), schema)


def bucket_topk(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, floor: float | None = None, buckets: DataFrame | None = None) -> DataFrame:
    """Exact cosine top ``k`` per query and source type within the query's tenant.

    ``queries``: query_id, tenant_id, qe.  ``vectors``: tenant_id, source_type,
    vec_id, embedding; a point is known by the first three.  ``buckets``
    (tenant_id, source_type) names the buckets to search, by default all.  A
    block of vectors emits ``k`` rows per query, never the pairs.  Ties go to the
    lower vec_id.
    """
    found = cell_topk(queries, vectors, ["tenant_id"], ["tenant_id", "source_type"], k, floor, buckets)
    return top_per_group(found.repartition("query_id"), ["query_id", "source_type"], [F.desc("score"), F.asc("vec_id")], k, "rank")


def topk(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, source_type: str | None = None, floor: float | None = None) -> DataFrame:
    """Exact cosine top ``k`` per query in its tenant: all vectors, or those of one source type."""
    if source_type is not None:
        return bucket_topk(queries, vectors.where(F.col("source_type") == source_type), k, floor)
    merged = bucket_topk(queries, vectors, k, floor).drop("rank")
    return top_per_group(merged, ["query_id"], [F.desc("score"), F.asc("source_type"), F.asc("vec_id")], k, "rank")


def _own_and_external(queries: DataFrame, vectors: DataFrame, sources: DataFrame | None, k: int) -> DataFrame:
    """Top ``k`` of the tenant's own bucket and of the external one, out of one product, with ``primary`` marking the own.

    ``sources`` (tenant_id, source_type) has each tenant's own type; a tenant
    without a row has ``PRIMARY``.
    """
    own = vectors.select("tenant_id").distinct()
    if sources is not None:
        named = sources.select("tenant_id", F.col("source_type").alias("_own"))
        own = own.join(named, "tenant_id", "left")
    else:
        own = own.withColumn("_own", F.lit(None).cast("string"))
    own = own.withColumn("_own", F.coalesce("_own", F.lit(PRIMARY)))
    buckets = own.select("tenant_id", F.explode(F.array(F.col("_own"), F.lit(EXTERNAL))).alias("source_type"))
    hits = bucket_topk(queries, vectors, k, buckets=buckets)
    return lookup(hits, own, ["tenant_id"], "query_id").withColumn("primary", F.col("source_type") == F.col("_own")).drop("_own")


def _by_score(hits: DataFrame, k: int) -> DataFrame:
    """One list per query: by score, the own bucket first on equal scores, cut to ``k``."""
    return top_per_group(hits, ["query_id"], [F.desc("score"), F.desc("primary"), F.asc("rank")], k, "position").drop("primary")


def union_rerank(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, sources: DataFrame | None = None) -> DataFrame:
    """Hits of the tenant's own and of the external bucket as one list of ``k``."""
    return _by_score(_own_and_external(queries, vectors, sources, k), k)


def two_bucket(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, sources: DataFrame | None = None) -> DataFrame:
    """Hits of the tenant's own bucket; where fewer than ``k`` or the best is below 0.7, blended with external ones.

    The test looks at the own hits before any score floor.
    """
    hits = _own_and_external(queries, vectors, sources, k)
    query = Window.partitionBy("query_id")
    n = F.count_if("primary").over(query)
    best = F.max(F.when(F.col("primary"), F.col("score"))).over(query)
    blend = (n < k) | (F.greatest(best, F.lit(0.0)) < BLEND_BELOW)
    return _by_score(hits.withColumn("_blend", blend).where("primary or _blend").drop("_blend"), k)


def min_score(hits: DataFrame, floor: float = SCORE_FLOOR) -> DataFrame:
    return hits.where(F.col("score") >= floor)


def with_payload(hits: DataFrame, vectors: DataFrame, *columns: str) -> DataFrame:
    """Hits with payload columns of their points; payloads never travel through the product."""
    return hits.join(vectors.select(*POINT, *columns), POINT)


def with_fallback(hits: DataFrame, tags: DataFrame) -> DataFrame:
    """Hits with the ``fallback_url`` of their tenant."""
    return lookup(hits, tags.select("tenant_id", "fallback_url"), ["tenant_id"], "query_id")


def citations(hits: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Cited hits: repaired URL (a hit without any is dropped), snippet, source, score.

    An unrepairable URL still gives its scheme-and-host root.
    """
    fixed = F.coalesce(F.nullif(urls.fix_url(F.col("url"), fallback), F.lit("")), F.nullif(urls.base_url(F.col("url")), F.lit("")))
    return hits.withColumn("url", fixed).where(F.col("url").isNotNull()).withColumn("snippet", text.snippet(F.col("content")))


def context_text(cited: DataFrame) -> DataFrame:
    """Add ``context``: source, URL and whole content of a hit."""
    block = F.concat(F.lit("Source: "), F.col("source"), F.lit("\nURL: "), F.col("url"), F.lit("\n"), F.col("content"))
    return cited.withColumn("context", block)


def pack_context(cited: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Contexts of a query within ``budget`` characters, in hit order.

    Each hit gets an equal share; if markers push the sum over the budget, the
    share shrinks by the overrun, to 500 characters at least.
    """
    query = Window.partitionBy("query_id")
    share = F.floor(F.lit(budget) / F.count(F.lit(1)).over(query)).cast("int")
    shared = cited.select("query_id", "position", "context").withColumn("_share", share)
    first = shared.withColumn("_cut", text.truncate_head_tail(F.col("context"), F.col("_share")))
    total = first.withColumn("_total", F.sum(F.length("_cut")).over(query))
    smaller = F.floor(F.col("_share") * (F.lit(float(budget)) / F.col("_total"))).cast("int")
    again = text.truncate_head_tail(F.col("context"), F.greatest(smaller, F.lit(CONTEXT_FLOOR)))
    final = total.withColumn("_final", F.when(F.col("_total") > budget, again).otherwise(F.col("_cut")))
    separator = SEPARATOR.replace("\n", "\\n")
    joined = F.expr(f"listagg(_final, '{separator}') within group (order by position)")
    return final.groupBy("query_id").agg(joined.alias("context"), F.count(F.lit(1)).alias("n_hits"))


def build_prompts(df: DataFrame) -> DataFrame:
    """Add ``system_prompt`` (brand, site) and ``user_prompt`` (question, context)."""
    site = F.coalesce(text.strip_ws(F.col("widget_website_url")), F.lit(""))
    clause = F.when(site != "", F.replace(F.lit(SITE_CLAUSE), F.lit("{site}"), site)).otherwise(F.lit(""))
    opening, rest = SYSTEM_PROMPT.split("{brand}")
    middle, ending = rest.split("{site}")
    system = F.concat(
        F.lit(opening), text.brand_label(F.col("brand_name"), F.col("name")), F.lit(middle), clause, F.lit(ending)
    )
    user = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\nContext: "), F.col("context"))
    return df.withColumns({"system_prompt": system, "user_prompt": user})


def cited_best(filtered: DataFrame, vectors: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """``(query_id, best)`` of queries with a cited hit; ``best`` counts hits that lost their URL too.

    The best score travels with the hits, so search and payload are planned once.
    """
    best = F.max("score").over(Window.partitionBy("query_id"))
    hits = with_payload(filtered.withColumn("best", best), vectors, "url", "content")
    cited = citations(hits) if tags is None else citations(with_fallback(hits, tags), F.col("fallback_url"))
    return cited.groupBy("query_id").agg(F.max("best").alias("best"))


def answer_confidence(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Best score above the floor, even if that hit lost its URL; 0 where nothing is cited."""
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("best", F.lit(0.0)).alias("confidence"))
