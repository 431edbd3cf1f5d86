"""Resharding by minimum-cost flow.

Old shards hold documents; new shards have capacities.  A flow from old to new
shards of least cost (a byte that stays costs nothing, one that moves costs 1)
says how many bytes go from where to where.  An old shard's documents lie in a
seeded order; each transfer is a block, a range of its bytes, and a document goes
with the block that holds its middle.  Only the table of shards passes through
the driver; documents are placed by running sums in two levels, so that a large
shard is spread over many tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import materialize, remove_dir

#: Documents of one stretch of an old shard, ordered within one task.
STRETCH_DOCS = 20_000
#: A document over this part of a new shard is large; there are at most so many times the shards.
EDGE_SHARE = 256
_FIRST = 1 << 32


def cheapest_flow(supply: list[int], demand: list[int], cost: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """Amounts from each supply to each demand at least total cost (successive shortest paths).

    Total supply may not exceed total demand.
    """
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # edges: [to, room, cost, place of the reverse edge]

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost(i, j))
    for j, d in enumerate(demand):
        edge(n + j, sink, d, 0)
    while True:
        best, via = {source: 0}, {}
        queue, waiting = deque([source]), {source}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room and best[a] + price < best.get(b, 1 << 60):
                    best[b], via[b] = best[a] + price, (a, k)
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if sink not in via:
            break
        path, b = [], sink
        while b != source:
            a, k = via[b]
            path.append(graph[a][k])
            b = a
        amount = min(e[1] for e in path)
        for e in path:
            e[1] -= amount
            graph[e[0]][e[3]][1] += amount
    return {(i, b - n): graph[b][back][1] for i in range(n) for b, _, _, back in graph[i] if n <= b < n + m and graph[b][back][1]}


def even(total: int, shards: int) -> list[int]:
    """Capacities that sum up to ``total`` and differ by one at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def reshard(
    docs: DataFrame, shards: int, old_shard: Column, capacities: Callable[[int], list[int]] | None = None, seed: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, size, text_crc32, old_shard, shard, slot)``, one row per input row.

    ``old_shard`` is the shard a row lies in now, a number from 0 on (null: 0), of
    which there may be few thousand.  ``capacities`` gives bytes per new shard from
    the total (default: even).  A size is the UTF-8 bytes of the text plus 1; null
    has none.  ``slot`` counts from 0 without gaps in each new shard.  Rows of one
    id or equal texts are placed one by one.  Other columns are not read; an empty
    table gives an empty result.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text).alias("_h"),
    )
    rows = materialize(rows, "reshard")
    held = rows.groupBy("old_shard").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy("old_shard").collect()
    old, sizes = [r["old_shard"] for r in held], [r["size"] for r in held]
    demand = capacities(sum(sizes)) if capacities else even(sum(sizes), shards)
    if sum(demand) < sum(sizes):
        raise ValueError("the capacities hold less than the documents")
    flow = cheapest_flow(sizes, demand, lambda i, j: int(old[i] != j))
    stretches = 1 + max([0, *(r["n"] for r in held)]) // STRETCH_DOCS
    # the largest documents, of which there are few, come first and by size, so that small ones lie at the edges of blocks
    large = F.col("size") * (len(demand) * EDGE_SHARE) > sum(sizes)
    rows = rows.withColumn("_key", F.when(large, F.greatest(F.lit(0), _FIRST - F.col("size"))).otherwise(F.greatest(F.shiftrightunsigned("_h", 1), F.lit(_FIRST + 1))))
    rows = rows.withColumn("_stretch", F.floor(F.col("_key") / float(1 << 63) * stretches).cast("long"))
    per_stretch = rows.groupBy("old_shard", "_stretch").agg(F.sum("size").alias("_bytes"))
    before = Window.partitionBy("old_shard").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_stretch.select("old_shard", "_stretch", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("old_shard", "_stretch").orderBy("_key", "_h", "text_crc32", "size")
    placed = rows.withColumn("_end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(offsets, ["old_shard", "_stretch"])
    middle = F.col("_base") + F.col("_end") - F.col("size") / 2
    placed = materialize(placed.withColumn("shard", _destination(flow, old, middle)).drop("_base"), "placed")
    counts = placed.groupBy("shard", "old_shard", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("old_shard", "_stretch").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "old_shard", "_stretch", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "old_shard", "_stretch").orderBy("_end", "_key", "_h", "text_crc32")
    numbered = placed.withColumn("_k", F.row_number().over(within) - 1).join(first, ["shard", "old_shard", "_stretch"])
    return numbered.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("_first") + F.col("_k")).cast("long").alias("slot"))


def _destination(flow: dict[tuple[int, int], int], old: list[int], at: Column) -> Column:
    """New shard of a place in an old one: what stays comes first, then blocks in order of the new shards."""
    by_old: dict[int, Column] = {}
    for i, number in enumerate(old):
        moves = sorted(((j, x) for (a, j), x in flow.items() if a == i), key=lambda m: (m[0] != number, m[0]))
        edge, column = sum(x for _, x in moves), F.lit(moves[-1][0])
        for j, amount in reversed(moves):
            edge -= amount
            column = F.when(at < edge + amount, F.lit(j)).otherwise(column)
        by_old[number] = column
    out = F.lit(None).cast("int")
    for number, column in by_old.items():
        out = F.when(F.col("old_shard") == number, column).otherwise(out)
    return out.cast("int")


def rewrite_affected(located: DataFrame, path: str) -> None:
    """Write the shards that gain or lose documents to ``path/shard=N``, leaving the others as they are.

    ``located`` has the documents with ``old_shard`` and ``shard``.  Only shards
    with a move are read and overwritten, each a folder of its own.  A shard that
    loses all its documents loses its folder once the others are written; a run that
    broke before may be repeated.
    """
    moved = located.where("old_shard <> shard")
    affected = moved.select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    rows = located.join(affected, "shard", "left_semi")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    emptied = affected.join(located.select("shard").distinct(), "shard", "left_anti").collect()  # a row per shard
    for row in emptied:
        remove_dir(located.sparkSession, f"{path.rstrip('/')}/shard={row['shard']}")
