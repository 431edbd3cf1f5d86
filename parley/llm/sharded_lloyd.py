"""Lloyd's algorithm over shards of dimensions.

Vectors of integers are cut into column blocks and written as one table with a folder
per block.  In every round tasks of a block compute the exact partial squared distances
of its slices to the block's slices of all centroids; a shuffle by row (``reduceByKey``)
adds the partial distances of a row's blocks and takes the argmin, the smaller number
on ties.  The slices travel beside their partial distances, so the same tasks add up the
slices of each cluster, and each shard then updates its own slice of the centroids.

Distances have four bytes each wherever they fit.  A row travels once per round in
each block, whatever the size of its cluster; sums are combined per task, so a cluster
that holds most rows is no hot key.  Only the k centroids reach the driver and the
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.vectors import floors, rows_of_length
from parley.llm.words import whole_keys
from parley.session import materialize

SCALE = 256
DIMENSIONS, CLUSTERS, ROUNDS = 64, 40, 5
#: Columns of one block.
BLOCK = 32

_INTS = (np.int16, np.int32, np.int64)


def pack(matrix: np.ndarray) -> pa.Array:
    """Rows as bytes, in the narrowest integers that hold all of them."""
    most = int(np.abs(matrix).max(initial=0))
    kind = next(t for t in _INTS if most <= np.iinfo(t).max)
    raw = matrix.astype(kind).tobytes()
    width = matrix.shape[1] * np.dtype(kind).itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())


def unpack(column: pa.Array, width: int) -> np.ndarray:
    """The int64 matrix of packed rows of ``width`` numbers."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    out = np.empty((len(column), width), dtype=np.int64)
    sizes = np.diff(offsets)
    for kind in _INTS:
        rows = np.flatnonzero(sizes == width * np.dtype(kind).itemsize)
        if len(rows):
            at = offsets[rows][:, None] + np.arange(width * np.dtype(kind).itemsize)
            out[rows] = raw[at].view(kind)
    return out


def _blocks(dimensions: int, scale: int, block: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, matrix = rows_of_length(batch.column("v"), dimensions)
            x = floors(matrix, scale)
            row = batch.column("row").take(pa.array(rows))
            ids = batch.column("id").take(pa.array(rows))
            for b, start in enumerate(range(0, dimensions, block)):
                own_id = ids if not b else pa.nulls(len(rows), ids.type)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), b, dtype=np.int32)), row, own_id, pack(x[:, start : start + block])], names=["block", "row", "id", "x"])

    return work


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, in float64 while every term stays under 2**53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 1 << 53 else np.int64 if 4 * most * most * x.shape[1] < 1 << 62 else object
    a, c = x.astype(kind), centroids.astype(kind)
    far = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
    if kind is object and far.size and far.max() >= 1 << 62:
        raise ValueError("a squared distance does not fit a long")
    return far.astype(np.int64)


def _partial(centroids: np.ndarray, block: int):
    """Partial distances of the slices of one block to its slices of all centroids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for b in np.unique(blocks).tolist():
                part = batch.filter(pa.array(blocks == b))
                own = centroids[:, b * block : (b + 1) * block]
                far = squared_distances(unpack(part.column("x"), own.shape[1]), own)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("block"), part.column("id"), part.column("x"), pack(far)], names=["row", "block", "id", "x", "far"])

    return work


def nearest(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order, their nearest centroids and distances, from all partial distances of those rows, sorted by row."""
    row = table.column("row").to_numpy()
    start = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
    far = np.add.reduceat(unpack(table.column("far").combine_chunks(), k), start, axis=0)
    best = far.argmin(axis=1)
    return start, best, far[np.arange(len(best)), best]


def _sums(k: int, dimensions: int, block: int):
    """Per task: the sum of each cluster's slices in each block, and its count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dimensions), dtype=np.int64), np.zeros(k, dtype=np.int64)

        def add(table: pa.Table) -> None:
            start, best, _ = nearest(table, k)
            row_of = np.repeat(np.arange(len(start)), np.diff(np.append(start, table.num_rows)))
            np.add.at(count, best, 1)
            blocks = table.column("block").to_numpy()
            for b in np.unique(blocks).tolist():
                mine = np.flatnonzero(blocks == b)
                width = min(block, dimensions - b * block)
                x = unpack(table.column("x").combine_chunks().take(pa.array(mine)), width)
                np.add.at(total[:, b * block : b * block + width], best[row_of[mine]], x)

        for _ in whole_keys(batches, "row", add):
            pass
        for b, at in enumerate(range(0, dimensions, block)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, b, dtype=np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(count), pa.array(total[:, at : at + block].tolist(), pa.list_(pa.int64()))],
                names=["block", "cluster", "count", "total"],
            )

    return work


def _labels(k: int, id_type: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def label(table: pa.Table) -> pa.RecordBatch:
            start, best, far = nearest(table, k)  # the first block of a row carries its id
            ids = table.column("id").combine_chunks().take(pa.array(start))
            return pa.RecordBatch.from_arrays([ids.cast(id_type), pa.array(best.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

        yield from whole_keys(batches, "row", label)

    return work


def _by_row(blocks: DataFrame, centroids: np.ndarray, block: int, id_type: str) -> DataFrame:
    partial = blocks.mapInArrow(_partial(centroids, block), f"row long, block int, id {id_type}, x binary, far binary")
    return partial.repartition("row").sortWithinPartitions("row", "block")


def _moved(blocks: DataFrame, centroids: np.ndarray, block: int, id_type: str) -> np.ndarray:
    """The centroids after one round; each block's slice is the floor of its clusters' means, empty clusters stay."""
    k, dimensions = centroids.shape
    sums = _by_row(blocks, centroids, block, id_type).mapInArrow(_sums(k, dimensions, block), "block int, cluster int, count long, total array<long>")
    added = sums.select("block", "cluster", "count", F.posexplode("total").alias("at", "s")).groupBy("block", "cluster", "at").agg(F.sum("count").alias("n"), F.sum("s").alias("s"))
    updated = added.where("n > 0").select("block", "cluster", "at", F.expr("s div n - if(pmod(s, n) <> 0 and s < 0, 1, 0)").alias("c"))
    out = centroids.copy()
    for r in materialize(updated, "centroids").collect():  # k * dimensions numbers
        out[r["cluster"], r["block"] * block + r["at"]] = r["c"]
    return out


def first_centroids(vectors: DataFrame, clusters: int, dimensions: int, scale: int, seed: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:id``, by hash, then by entries where ids repeat."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.size("v") == dimensions).where(finite)
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = kept.select(F.sha2(text, 256).alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return floors(np.array([r["v"] for r in first], dtype=np.float64).reshape(-1, dimensions), scale)


def cluster(
    embeddings: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = 2,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, one row per kept vector.

    Kept are vectors with ``dimensions`` entries, none null or non-finite; entries become
    ``floor(scale * x)`` and must fit 62 bits.  The first centroids are the kept rows with
    the smallest SHA-256 of ``seed:id`` (a null id is empty there); fewer rows give fewer
    centroids, an empty table no rows.  Repeated rows count as often as they stand, and a
    centroid that only ties with an equal one of smaller number is empty and stays.
    Columns other than id and vector are not read.
    """
    id_type = embeddings.schema[id_col].dataType.simpleString()
    vectors = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    centroids = first_centroids(vectors, clusters, dimensions, scale, seed)
    if not len(centroids):
        empty = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return embeddings.sparkSession.createDataFrame([], empty).select(F.lit(None).cast(id_type).alias("vec_id"), "*")
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "id", "v")
    blocks = materialize(numbered.mapInArrow(_blocks(dimensions, scale, block), f"block int, row long, id {id_type}, x binary"), "blocks", by=("block",))
    for _ in range(rounds):
        centroids = _moved(blocks, centroids, block, id_type)
    arrow_type = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()
    labels = _by_row(blocks, centroids, block, id_type).mapInArrow(_labels(len(centroids), arrow_type), f"vec_id {id_type}, cluster int, distance long")
    labels = materialize(labels, "labels")
    inertia = {r["cluster"]: r["s"] for r in labels.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    hashes = F.array(*[F.sha2(F.lit(",".join(map(str, c))), 256) for c in centroids.tolist()])
    sums = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))])
    return labels.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(sums, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.get(hashes, F.col("cluster")).alias("centroid_sha256"),
    )
