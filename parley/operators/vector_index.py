"""Approximate cosine search: an index of hashed hyperplane columns.

Each table of the index has its own random hyperplanes; the sides a vector lies on
make up its code there, and a code is a column that queries join on.  The number of
hyperplanes follows the size of a tenant's source type, so that a cell keeps about
``cell_rows`` points at every size.  A query looks into the cell of its own code and
into those it would reach by crossing the hyperplanes nearest to it.  What a cell
holds is scored exactly, ``k`` rows per query and cell leave it, never pairs.

Recall depends on how near the wanted neighbours are: those at cosine 0.9 lie on
the same side of a hyperplane with probability 0.86, those at 0.3 with 0.6.  More
tables and more crossed hyperplanes buy recall for candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.groups import attach_group, lookup, top_per_group
from parley.operators.retrieval import POINT, TOP_K, cell_topk

BUCKET = ["tenant_id", "source_type"]
#: Codes share 64 bits with the number of their table.
_MOST_BITS = 48


@dataclass(frozen=True)
class HyperplaneIndex:
    """``tables`` code columns, cells of about ``cell_rows`` points, ``crossed`` hyperplanes tried from both sides.

    A query asks ``2 ** crossed`` cells of every table.  A source type of up to
    ``cell_rows * 2 ** crossed`` points is thereby searched as a whole.
    """

    tables: int = 8
    cell_rows: int = 512
    crossed: int = 3
    seed: int = 7

    def __post_init__(self):
        if self.tables < 1 or self.cell_rows < 1 or self.crossed < 0:
            raise ValueError("tables and cell_rows must be positive, crossed must not be negative")

    def build(self, vectors: DataFrame) -> DataFrame:
        """``(tenant_id, source_type, vec_id, embedding, bits, cells)`` of ``vectors``, to be written beside the collection.

        Points without a vector are left out, as exact search cannot find them.
        """
        points = _points(vectors)
        bits = F.greatest(F.ceil(F.log2(F.count(F.lit(1)) / F.lit(self.cell_rows))), F.lit(0))
        sized = attach_group(points, BUCKET, {"bits": F.least(bits, F.lit(_MOST_BITS)).cast("int")}, slice_on="vec_id")
        return self._hashed(sized)

    def add(self, index: DataFrame, vectors: DataFrame) -> DataFrame:
        """Rows to append to ``index`` for new points, hashed by as many hyperplanes as their source type has there.

        Source types that the index lacks are sized by the new points.  One that has
        grown many times over stays correct but is worth building anew.
        """
        known = index.groupBy(*BUCKET).agg(F.max("bits").alias("_bits"))
        fresh = self.build(vectors).drop("cells")
        sized = lookup(fresh, known, BUCKET, slice_on="vec_id").withColumn("bits", F.coalesce("_bits", "bits")).drop("_bits")
        return self._hashed(sized)

    def topk(self, queries: DataFrame, index: DataFrame, k: int = TOP_K, floor: float | None = None) -> DataFrame:
        """Approximate ``bucket_topk`` of ``queries(query_id, tenant_id, qe)``: scores are exact, a hit may be missing.

        Ties go to the lower vec_id.  Queries without a vector find nothing.
        """
        sizes = index.groupBy(*BUCKET).agg(F.max("bits").alias("bits"))
        per_tenant = sizes.groupBy("tenant_id").agg(F.collect_list(F.struct("source_type", "bits")).alias("_types"))
        wanted = queries.select("tenant_id", "query_id", "qe").where("qe is not null")
        wanted = lookup(wanted, per_tenant, ["tenant_id"], slice_on="query_id", how="inner")
        wanted = wanted.select("tenant_id", "query_id", "qe", F.explode("_types").alias("_t")).select("tenant_id", "query_id", "qe", "_t.*")
        schema = f"{_ddl(wanted)}, cells array<bigint>"
        probes = wanted.mapInArrow(_add_cells("qe", self.tables, self.seed, self.crossed), schema)
        probes = probes.select(*BUCKET, "query_id", "qe", F.explode("cells").alias("cell"))
        points = index.select(*POINT, "embedding", F.explode("cells").alias("cell"))
        cell = [*BUCKET, "cell"]
        found = cell_topk(probes, points, cell, cell, k, floor)
        # a point may be found in several tables
        once = found.repartition("query_id").dropDuplicates(["query_id", *POINT])
        return top_per_group(once, ["query_id", "source_type"], [F.desc("score"), F.asc("vec_id")], k, "rank")

    def _hashed(self, sized: DataFrame) -> DataFrame:
        schema = f"{_ddl(sized)}, cells array<bigint>"
        return sized.mapInArrow(_add_cells("embedding", self.tables, self.seed, None), schema).select(*POINT, "embedding", "bits", "cells")


def _points(vectors: DataFrame) -> DataFrame:
    return vectors.select(*POINT, "embedding").where("embedding is not null")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _add_cells(column: str, tables: int, seed: int, crossed: int | None):
    """Append ``cells``: of every table the cell of a vector, or the cells that a query asks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            vectors = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 1)
            bits = batch.column("bits").to_numpy()
            parts = [_codes(vectors, bits, table, seed, crossed) * tables + table for table in range(tables)]
            cells = np.concatenate(parts, axis=1) if parts else np.zeros((batch.num_rows, 0), dtype=np.int64)
            keep = np.ones(cells.shape, dtype=bool)
            if crossed is not None:  # a query crosses no more hyperplanes than its source type has
                ways = 1 << np.minimum(bits, crossed)
                keep = np.tile(np.arange(1 << crossed)[None, :] < ways[:, None], (1, tables))
            offsets = pa.array(np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(cells[keep]))], names=[*batch.schema.names, "cells"]
            )

    return work


def _codes(vectors: np.ndarray, bits: np.ndarray, table: int, seed: int, crossed: int | None) -> np.ndarray:
    """Codes of one table, a row per vector: its own, then those beyond its nearest hyperplanes."""
    most = int(bits.max(initial=0))
    # a plane depends on its table and number only, so more of them leave the first ones as they are
    planes = [np.random.default_rng([seed, table, i]).normal(size=vectors.shape[1]) for i in range(most)]
    sides = vectors @ np.array(planes).T if most else np.zeros((len(vectors), 0))
    used = np.arange(most)[None, :] < bits[:, None]
    own = (((sides >= 0) & used) * (np.int64(1) << np.arange(most, dtype=np.int64))[None, :]).sum(axis=1).astype(np.int64)
    out = own[:, None]
    if crossed is not None:
        nearest = np.argsort(np.where(used, np.abs(sides), np.inf), axis=1, kind="stable")
        for i in range(crossed):
            flip = np.where(i < bits, np.int64(1) << (nearest[:, i].astype(np.int64) if i < most else np.int64(0)), 0)
            out = np.concatenate([out, out ^ flip[:, None]], axis=1)
    return out


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``wanted`` exact hits, how many of them were ``found``, and their share (1.0 where none is wanted).

    Both sides: query_id and the point.  Equal scores at the last rank count by id,
    as the exact search decides.
    """
    hits = exact.select("query_id", *POINT).join(found.select("query_id", *POINT, F.lit(1).alias("_hit")), ["query_id", *POINT], "left")
    total = hits.agg(F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("found"))
    return total.withColumn("recall", F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).otherwise(1.0))
