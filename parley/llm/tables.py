"""Helpers over DataFrames shared by the operators here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import discard, materialize

#: Stands for a null id: after all others.
NO_ID = 2**63 - 1


def own_exchange(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_route``, a hash of ``keys``.

    A join on it shuffles both sides anew, also one that an aggregate on the same
    keys has just dealt out; only then can AQE split a hot key of the other side.
    """
    return df.withColumn("_route", F.xxhash64(*keys))


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join whose hot keys on the left AQE can split; ``right`` is small per key."""
    return own_exchange(left, keys).join(own_exchange(right, keys), [*keys, "_route"], how).drop("_route")


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest place reachable from each of ``n`` places over links ``a - b``, for use inside tasks."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            return label


#: Links contracted at once inside a task, 16 bytes each.
_CONTRACTED = 1 << 20


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``(a, b)``, b the smaller, that connect what the links of the task connect: a star for each set."""
    held: list[np.ndarray] = []

    def stars() -> pa.RecordBatch:
        nodes, place = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        place = place.reshape(2, -1)
        root = nodes[spanning(place[0], place[1], len(nodes))]
        far = root != nodes
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], names=["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]))
        if sum(h.shape[1] for h in held) > _CONTRACTED:
            yield stars()
    if held:
        yield stars()


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``(id, component)`` for the ends of ``edges(a, b)``: the smallest id reachable.

    Alternating star contraction: each step points the larger neighbours of every
    node to its smallest one, then the smaller ones.  Tasks contract the links they
    read before anything is shuffled.  Every step combines before
    its shuffle, is written to the shared folder, and its joins can be split, so
    that a node with very many links stays spread out.
    """
    contract = lambda df: df.mapInArrow(_contracted, "a long, b long")
    links = materialize(contract(edges.select("a", "b")).distinct(), purpose)
    while not _all_stars(links):
        last, links = links, materialize(_small_star(_large_star(contract(links))), purpose)
        discard(last)
    roots = links.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def _all_stars(links: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none: nothing is left to contract."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("root")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("root"))))
    nodes = links.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
    return nodes.where("out + root > 1").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return split_join(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    inner = split_join(links, least, ["a"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.union(least.select("a", F.col("m").alias("b"))).distinct()
