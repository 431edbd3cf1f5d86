"""Mixing sources to target weights by Sainte-Laguë apportionment of blocks.

Targets fill up by weight, no source beyond a number of repeats of itself.  Blocks
of equal word count go to sources by highest quotients, then to the shards of each
source in the same way; a shard takes its quota from its own blocks, each as often
as the others within one, from a seeded start.  Documents lie in a shard in seeded
order, so blocks are random samples; how often a block is taken has a closed form
and no block is ever a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators import groups
from parley.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents a shard of a source has about.
SHARD_DOCS = 20_000
MAX_BLOCK = 1024


def apportion(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients ``votes / (2 * seats_so_far + 1)``, none above its cap, the first by place among equals."""
    votes, caps = votes.astype(np.float64), np.where(votes > 0, caps, 0).astype(np.int64)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(votes), dtype=np.int64)
    given = lambda divisor: np.minimum(caps, np.floor(np.minimum(votes / divisor + 0.5, 2.0**62)).astype(np.int64))
    low, high = votes[votes > 0].min() / (2.0 * seats + 2), 2 * votes.max() + 1
    while given(low).sum() < seats:
        low /= 4
    for _ in range(200):
        middle = (low + high) / 2
        if given(middle).sum() > seats:
            low = middle
        else:
            high = middle
    out = given(high)
    while (rest := seats - int(out.sum())) > 0:
        open_ = np.flatnonzero(out < caps)
        best = open_[np.argsort(-votes[open_] / (2 * out[open_] + 1), kind="stable")][:rest]
        out[best] += 1
    return out


def fill(words: np.ndarray, weights: np.ndarray, share: float, repeats: int) -> np.ndarray:
    """Targets by weight; what a source cannot take goes to the others by weight."""
    caps = repeats * words.astype(np.float64)
    target = np.zeros(len(words))
    free = (caps > 0) & (weights > 0)
    pool = min(share * float(words.sum()), float(caps[free].sum()))
    while free.any() and pool > 0:
        part = np.where(free, pool * weights / weights[free].sum(), 0.0)
        full = free & (part >= caps)
        if not full.any():
            return target + part
        target[full] = caps[full]
        pool -= caps[full].sum()
        free &= ~full
    return target


def _plan_sources(weights: tuple[float, ...], share: float, repeats: int, max_block: int):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(pdf)), key=lambda i: (pdf["source"].iloc[i] is None, pdf["source"].iloc[i] or ""))
        pdf = pdf.iloc[order].reset_index(drop=True)
        words = pdf["source_size"].to_numpy()
        weight = np.array([weights[i % len(weights)] for i in range(len(pdf))], dtype=np.float64)
        target = fill(words, weight, share, repeats)
        least = target[target > 0].min() if (target > 0).any() else 1.0
        block = int(np.clip(least // 64, 1, max_block))
        quota = apportion(target, round(target.sum() / block), repeats * -(-words // block))
        return pdf.assign(target=target, block=block, quota=quota)[["source", "source_size", "shards", "target", "block", "quota"]]

    return plan


def _plan_shards(repeats: int):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard").reset_index(drop=True)
        blocks = -(-pdf["words"].to_numpy() // pdf["block"].to_numpy())
        taken = apportion(pdf["words"].to_numpy(), int(pdf["quota"].iloc[0]), repeats * blocks)
        return pdf.assign(blocks=blocks, taken=taken)[["source", "shard", "source_size", "target", "block", "blocks", "taken"]]

    return plan


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.0,
    repeats: int = 3,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, copies, row_hash)``, one row per input row.

    Sources in code point order, null last, have the weights in turn; together
    they get ``share`` of all words, each at most ``repeats`` times its own.
    ``taken`` counts the document's words in taken blocks, with repeats; ``copies``
    is how often the block of its first word is taken, for users of whole
    documents.  ``row_hash`` identifies id and text.  A null text has size 0; a
    document without words takes nothing and has no copies.  Other columns are
    not read.  Only the list of sources (one row each) passes through one task.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), row_hash(seed, id_col, text_col).alias("row_hash")
    )
    rows = materialize(rows, "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), (1 + F.floor(F.count(F.lit(1)) / SHARD_DOCS)).cast("long").alias("shards"))
    planned = totals.groupBy().applyInPandas(
        _plan_sources(weights, share, repeats, MAX_BLOCK), "source string, source_size long, shards long, target double, block long, quota long"
    )
    planned = materialize(planned, "sources").withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    keyed = rows.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    dealt = groups.lookup(keyed, planned.select("source_key", "shards"), ["source_key"], "row_hash").withColumn("shard", F.pmod(F.xxhash64("row_hash"), F.col("shards")))
    dealt = materialize(dealt.drop("shards"), "dealt")
    per_shard = dealt.groupBy("source_key", "shard").agg(F.sum("size").alias("words"))
    shards = per_shard.join(planned.drop("shards"), "source_key").groupBy("source_key").applyInPandas(
        _plan_shards(repeats), "source string, shard long, source_size long, target double, block long, blocks long, taken long"
    )
    shards = shards.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumnRenamed("taken", "quota").drop("source")
    shards = shards.withColumn("turn", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), "source_key", "shard"), F.col("blocks"))))
    order = Window.partitionBy("source_key", "shard").orderBy("row_hash", "size")
    placed = dealt.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(materialize(shards, "shards"), ["source_key", "shard"]).withColumn("start", F.col("end") - F.col("size"))
    times = "(quota div blocks) * ({k}) + ((({k}) + turn) * (quota % blocks)) div blocks - (turn * (quota % blocks)) div blocks"
    before = lambda k: "(" + times.format(k=k) + ")"
    of = lambda p: f"(block * {before(f'{p} div block')} + ({p} % block) * ({before(f'{p} div block + 1')} - {before(f'{p} div block')}))"
    some = (F.col("size") > 0) & (F.col("blocks") > 0)
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.when(some, F.expr(f"{of('end')} - {of('start')}")).otherwise(0).cast("long").alias("taken"),
        F.when(some, F.expr(f"{before('start div block + 1')} - {before('start div block')}")).otherwise(0).cast("int").alias("copies"),
        "row_hash",
    )


def row_hash(seed: int, id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col))


def take_documents(docs: DataFrame, mixed: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, each as often as its ``copies``; rows of equal id and text all as often as the most taken of them."""
    copies = mixed.groupBy("row_hash").agg(F.max("copies").alias("_copies")).where("_copies > 0").withColumnRenamed("row_hash", "_hash")
    chosen = docs.withColumn("_hash", row_hash(seed, id_col, text_col)).join(copies, "_hash")
    return chosen.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
