"""Ranking and group look-ups that stay spread out when one group is huge.

A window over a hot key puts the whole group into one task, and a join back on
an aggregate's own key cannot be split by AQE because the aggregate side has no
exchange of its own.  The two helpers here avoid both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of a group in :func:`attach_group`; one bit each in a signed 64-bit mask.
SLICES = 48


def with_slice(df: DataFrame, on: str) -> DataFrame:
    """Add ``_slice``, a hash of ``on`` in 0..47."""
    return df.withColumn("_slice", F.pmod(F.xxhash64(on), F.lit(SLICES)).cast("int"))


def slice_mask() -> Column:
    """Aggregate: which slices a group has, one bit each."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_slice"))).alias("_mask")


def spread_slices(groups: DataFrame) -> DataFrame:
    """Repeat each group once per slice it has, so that rows can join on key and slice."""
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(SLICES - 1)),
        lambda i: F.call_function("getbit", F.col("_mask"), i) == 1,
    )
    return groups.withColumn("_slice", F.explode(bits)).drop("_mask")


def in_order(df: DataFrame, ordered: bool, *order) -> DataFrame:
    """``df`` sorted if asked for: a global sort deals out all rows anew, which only a short listing is worth."""
    return df.orderBy(*order) if ordered else df


def attach_group(df: DataFrame, keys: list[str], aggs: dict[str, Column], slice_on: str) -> DataFrame:
    """Add group aggregates to every row without bringing a group together.

    Rows are sliced by a hash of ``slice_on``.  The aggregate (combined before
    its shuffle) also records which slices a group has as a bit mask, and is
    repeated once per slice present, so the join runs on ``keys + slice``: a hot
    group spreads over up to 48 partitions and a small one costs no extra rows.
    """
    sliced = with_slice(df, slice_on)
    groups = sliced.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()], slice_mask())
    return sliced.join(spread_slices(groups), [*keys, "_slice"]).drop("_slice")


def ranked(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "rn") -> DataFrame:
    """Exact ``row_number() over (partition by keys order by order)`` in two levels.

    ``bucket`` must not decrease along ``order`` (an hour of the leading
    timestamp, a range of a leading id).  Rows are numbered inside
    ``keys + bucket``; bucket sizes, which are few, give the running offset.
    """
    bucketed = df.withColumn("_bucket", bucket)
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = bucketed.withColumn("_local", F.row_number().over(within)).alias("l")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "_bucket"]])
    joined = local.join(offsets.alias("o"), same)
    return joined.select("l.*", (F.col("o._offset") + F.col("l._local")).alias(name)).drop("_bucket", "_local")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rn") -> DataFrame:
    """First ``n`` rows per group; Spark cuts each map side to ``n`` rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    leading = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return leading.withColumn(name, F.col(name).cast("bigint"))


def _first_by(pick, df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    row = F.struct(*[c for c in df.columns if c not in keys])
    best = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as an aggregate that combines before the shuffle."""
    return _first_by(F.max_by, df, keys, order)


def oldest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the smallest ``order`` per key; see :func:`newest`."""
    return _first_by(F.min_by, df, keys, order)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], slice_on: str, how: str = "left") -> DataFrame:
    """Join to a side that is unique per key, safe when one key holds much of ``left``.

    The distinct keys of ``left`` (combined before the shuffle) pick up the
    right columns once; only then do they fan out to the slices of their rows.
    """
    sliced = with_slice(left, slice_on)
    found = sliced.select(*keys, "_slice").distinct().join(right, keys)
    return sliced.join(found, [*keys, "_slice"], how).drop("_slice")
