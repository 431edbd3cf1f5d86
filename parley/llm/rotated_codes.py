"""Near-duplicate vectors through binary codes of randomised rotations.

1. *Nodes.*  Equal vectors become one node that counts its copies.  A node stores the
   signs of its randomly rotated unit vector and the correction factor ``a``, the inner
   product of that vector with its own code.
2. *Buckets.*  In each of several tables nodes meet under a cross-polytope hash (the
   largest coordinate of further rotations).  The number of buckets follows the number
   of rows, so buckets stay about as full at every size, and the number of tables
   follows from the collision rate at the threshold, so that a link at the threshold is
   met with probability ``recall``, a closer one more surely.
3. *Estimates.*  In a bucket ``<code, z> / a`` estimates the inner product with another
   node's rotated vector ``z`` without bias.  Its error is ``sqrt(1 - a*a) / a`` times
   the part of ``z`` across the first vector times a coordinate of a random direction,
   which bounds what a link can show: pairs below the bound in either direction are
   dropped, all others are recomputed exactly.
4. *Balls.*  Families of near copies would make buckets quadratic.  Means of full
   buckets become centres, of which the largest of each neighbourhood stays; nodes within
   half the angle of the threshold of a centre form its ball and link with one another
   for certain.  They are counted as a whole and never compared.  A bucket that is still
   large is cut into blocks by ball; two blocks of one ball never meet.

A pair counts in the first table where it shares a bucket, so buckets emit link counts
per node and one spanning star per connected set, never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.tables import NO_ID, components, spanning, split_join
from parley.llm.vectors import by_length
from parley.llm.words import groups
from parley.session import discard, materialize

THRESHOLD = 0.95
#: Chance that a pair exactly at the threshold is met.
RECALL = 0.998
#: Rows a bucket has on average, rows of one block, rows that make a bucket a source of a centre.
BUCKET, BLOCK, FULL = 192, 2048, 256
#: Error bound of an estimate in standard deviations.
DEVIATIONS = 6.0
#: Tables whose buckets travel at once; each table sends every vector once.
AT_ONCE = 2
#: Tables whose full buckets give centres.
CENTRE_TABLES = 3

_PAIRS_AT_ONCE = 1 << 15


@lru_cache(maxsize=64)
def rotation(length: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([length, seed]).normal(size=(length, length)))
    return q * np.sign(np.diag(r))


def parts_of(length: int, rows: int, bucket: int) -> list[int]:
    """Coordinates of each part of a hash, so that ``rows`` rows of ``length`` entries fill buckets with ``bucket`` of them."""
    left, parts = max(1.0, rows / bucket), []
    while left > 1.5:
        taken = min(length, max(1, 1 << round(math.log2(left / 2)) if left > 2 else 1))
        parts.append(taken)
        left /= 2 * taken
    return parts


def _polytope(units: np.ndarray, taken: int, seed: int) -> np.ndarray:
    turned = units @ rotation(units.shape[1], seed)[:, :taken]
    at = np.abs(turned).argmax(axis=1)
    return 2 * at + (turned[np.arange(len(at)), at] > 0)


def hashes(units: np.ndarray, tables: int, parts: list[int]) -> np.ndarray:
    """Bucket numbers, a column per table; vectors of other lengths have other numbers."""
    out = np.full((len(units), tables), units.shape[1], dtype=np.int64)
    for t in range(tables):
        for i, taken in enumerate(parts):
            out[:, t] = out[:, t] * (2 * taken) + _polytope(units, taken, 1 + 64 * t + i)
    return out


@lru_cache(maxsize=16)
def tables_for(length: int, parts: tuple[int, ...], threshold: float, recall: float) -> int:
    """Tables needed to meet a pair at the threshold with probability ``recall``, by the collisions of seeded random pairs."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, length))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.maximum(np.linalg.norm(z, axis=1), 1e-300)[:, None]
    y = threshold * x + math.sqrt(1 - threshold**2) * z
    rate = max(0.001, float((hashes(x, 1, list(parts)) == hashes(y, 1, list(parts))).mean()) - 0.02)
    return 1 if rate >= recall else math.ceil(math.log(1 - recall) / math.log(1 - rate))


def units_of(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that are not zero, and which rows those are."""
    most = np.abs(matrix).max(axis=1, initial=0)
    rows = np.flatnonzero(most > 0)
    scaled = matrix[rows] / most[rows, None]
    return scaled / np.linalg.norm(scaled, axis=1)[:, None], rows


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors, and correction factors."""
    turned = units @ rotation(units.shape[1], 0)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(units.shape[1])


def estimates(codes: np.ndarray, factors: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded vectors (rows) with other vectors (columns)."""
    length = units.shape[1]
    signs = np.unpackbits(codes, axis=1, count=length).astype(np.float32) * 2 - 1
    turned = (units @ rotation(length, 0)).astype(np.float32)
    return (signs @ turned.T) / (math.sqrt(length) * factors)[:, None].astype(np.float32)


def least_estimate(factors: np.ndarray, length: int, threshold: float) -> np.ndarray:
    """What the estimate of a pair at the threshold or above does not fall below, but for the chance of ``DEVIATIONS``."""
    across = np.sqrt(np.maximum(0, 1 - factors**2)) / factors * math.sqrt(max(0.0, 1 - threshold**2))
    return threshold - across * min(1.0, DEVIATIONS / math.sqrt(max(1, length - 1))) - 1e-5


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _number(raw: bytes) -> tuple[int, int]:
    digest = hashlib.md5(raw, usedforsecurity=False).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


_NODE = "id long, d int, h1 long, h2 long, raw binary, code binary, factor double, keys array<long>"


def _described(plans: dict[int, tuple[list[int], int]]):
    """Rows that can link: length, digest, vector, code, factor and bucket numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in by_length(batch.column("v")):
                if not len(rows) or not matrix.shape[1]:
                    continue
                units, kept = units_of(matrix)
                rows, matrix, length = rows[kept], matrix[kept] + 0.0, matrix.shape[1]  # + 0.0 turns -0.0 into 0.0
                h1, h2 = zip(*[_number(r.tobytes()) for r in matrix]) if len(rows) else ((), ())
                narrow = matrix.astype(np.float32)
                exact = (narrow == matrix).all(axis=1)
                raw = [(a if e else b).tobytes() for a, b, e in zip(narrow, matrix, exact)]
                codes, factors = encode(units)
                parts, tables = plans[length]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(rows)), pa.array(np.full(len(rows), length, dtype=np.int32)), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                        pa.array(raw, pa.binary()), _binary(codes), pa.array(factors), pa.array(hashes(units, tables, parts).tolist(), pa.list_(pa.int64())),
                    ],
                    names=["id", "d", "h1", "h2", "raw", "code", "factor", "keys"],
                )

    return work


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row's id and digest, which is null where the vector links with nothing."""
    for batch in batches:
        found: list[tuple[int, int] | None] = [None] * batch.num_rows
        for rows, matrix in by_length(batch.column("v")):
            for r, v in zip(rows.tolist(), matrix + 0.0):
                if v.any():
                    found[r] = _number(v.tobytes())
        h1, h2 = ([None if f is None else f[i] for f in found] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["id", "h1", "h2"])


def _vectors(raw: list[bytes], length: int) -> np.ndarray:
    """Unit vectors of stored rows of one length."""
    out = np.empty((len(raw), length))
    for i, r in enumerate(raw):
        out[i] = np.frombuffer(r, dtype=np.float32 if len(r) == 4 * length else np.float64)
    return units_of(out)[0]


def _met(threshold: float):
    """Link counts and stars of each bucket or pair of blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["t", "key", "low", "high"]):
            if table.num_rows < 2:
                continue
            table = table.combine_chunks()
            one = {c: table.column(c)[0].as_py() for c in ("t", "low", "high", "d")}
            node, ball, copies, block = (table.column(c).to_numpy() for c in ("node", "ball", "copies", "block"))
            units = _vectors(table.column("raw").to_pylist(), one["d"])
            codes = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype=np.uint8).reshape(len(node), -1)
            factors = table.column("factor").to_numpy()
            keys = np.array(table.column("before").to_pylist(), dtype=np.int64).reshape(len(node), -1)
            least = least_estimate(factors, one["d"], threshold)
            split = one["low"] != one["high"]
            left = np.flatnonzero(block == one["low"]) if split else np.arange(len(node))
            right = np.flatnonzero(block == one["high"]) if split else left
            linked = []
            for at in range(0, len(left), BLOCK):
                rows = left[at : at + BLOCK]
                maybe = estimates(codes[rows], factors[rows], units[right]) >= least[rows, None]
                maybe &= estimates(codes[right], factors[right], units[rows]).T >= least[None, right]
                i, j = np.nonzero(maybe)
                i, j = rows[i], right[j]
                keep = (ball[i] != ball[j]) | (ball[i] < 0)
                if not split:
                    keep &= i < j
                i, j = i[keep], j[keep]
                for k in range(0, len(i), _PAIRS_AT_ONCE):  # exact recomputation
                    x, y = i[k : k + _PAIRS_AT_ONCE], j[k : k + _PAIRS_AT_ONCE]
                    sure = np.einsum("ij,ij->i", units[x], units[y]) >= threshold
                    x, y = x[sure], y[sure]
                    fresh = ~(keys[x] == keys[y]).any(axis=1)  # not met in an earlier table
                    linked.append(np.stack([x[fresh], y[fresh]]))
            i, j = np.concatenate(linked, axis=1) if linked else (left[:0], left[:0])
            if len(i):
                count = np.zeros(len(node), dtype=np.int64)
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                root = spanning(i, j, len(node))
                rows = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(node[root[rows]]), pa.array(count[rows])], names=["a", "b", "n"])

    return work


def _bucket_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors per bucket, combined within a task."""
    held: dict[tuple, list] = {}

    def out() -> pa.RecordBatch:
        rows = [(*k, v[0], v[1].tobytes()) for k, v in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["t", "key", "d", "n", "sum"])

    for batch in batches:
        t, key, d = (batch.column(c).to_numpy() for c in ("t", "key", "d"))
        raw = batch.column("raw").to_pylist()
        for length in np.unique(d).tolist():
            mine = np.flatnonzero(d == length)
            units = _vectors([raw[i] for i in mine], length)
            kinds, place = np.unique(np.stack([t[mine], key[mine]]), axis=1, return_inverse=True)
            place = place.ravel()
            sums = np.zeros((kinds.shape[1], length))
            np.add.at(sums, place, units)
            for k, (a, b) in enumerate(kinds.T.tolist()):
                entry = held.setdefault((a, b, length), [0, np.zeros(length)])
                entry[0] += int((place == k).sum())
                entry[1] += sums[k]
        if len(held) > 4096:
            yield out()
    if held:
        yield out()


def _centres(plans: dict[int, tuple[list[int], int]]):
    """One centre per full bucket, with its own bucket numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["t", "key"]):
            length = table.column("d")[0].as_py()
            total = sum(np.frombuffer(s, dtype=np.float64) for s in table.column("sum").to_pylist())
            units, kept = units_of(total[None, :])
            if len(kept):
                parts, tables = plans[length]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([length], pa.int32()), pa.array([sum(table.column("n").to_pylist())], pa.int64()), _binary(units), pa.array(hashes(units, tables, parts).tolist(), pa.list_(pa.int64()))],
                    names=["d", "n", "unit", "keys"],
                )

    return work


def _leading(near: float):
    """For centres that meet in a bucket: whether a larger one is close by (``led``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["t", "key"]):
            table = table.combine_chunks()
            units = np.stack([np.frombuffer(u, dtype=np.float64) for u in table.column("unit").to_pylist()])
            centre, n = table.column("centre").to_numpy(), table.column("n").to_numpy()
            led, open_ = np.zeros(len(n), dtype=bool), np.ones(len(n), dtype=bool)
            for i in np.lexsort((centre, -n)).tolist():
                if open_[i]:
                    close = open_ & (units @ units[i] >= near)
                    led |= close
                    led[i] = False
                    open_ &= ~close
            yield pa.RecordBatch.from_arrays([pa.array(centre), pa.array(led)], names=["centre", "led"])

    return work


def _within(cosine: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("d").to_numpy()
            raw, unit = batch.column("raw").to_pylist(), batch.column("unit").to_pylist()
            inside = np.array([bool(_vectors([r], d)[0] @ np.frombuffer(u, dtype=np.float64) >= cosine) for r, u, d in zip(raw, unit, length.tolist())], dtype=bool)
            yield batch.select(["node", "centre", "n"]).filter(pa.array(inside))

    return work


def _balls(nodes: DataFrame, plans: dict[int, tuple[list[int], int]], threshold: float, full: int) -> DataFrame | None:
    """``(node, ball)`` for nodes within half the threshold's angle of the centre of a full bucket."""
    met = nodes.select("node", F.posexplode("keys").alias("t", "key"))
    early = met.where(F.col("t") < CENTRE_TABLES)
    crowded = materialize(early.groupBy("t", "key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= full).select("t", "key"), "crowded")
    if crowded.isEmpty():
        return None
    rows = nodes.select("raw", "d", F.posexplode("keys").alias("t", "key")).where(F.col("t") < CENTRE_TABLES)
    sums = split_join(rows, crowded, ["t", "key"]).mapInArrow(_bucket_sums, "t int, key long, d int, n long, sum binary")
    centres = sums.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_centres(plans), "d int, n long, unit binary, keys array<long>")
    centres = materialize(centres.select(F.monotonically_increasing_id().alias("centre"), "*"), "centres")
    meeting = centres.select("centre", "n", "unit", F.posexplode("keys").alias("t", "key")).repartition("t", "key").sortWithinPartitions("t", "key")
    near = meeting.mapInArrow(_leading(math.cos(math.radians(4.0))), "centre long, led boolean")
    first = near.groupBy("centre").agg(F.max("led").alias("led")).where("not led").select("centre")
    kept = materialize(centres.join(first, "centre"), "balls")
    seen = split_join(met, kept.select("centre", F.posexplode("keys").alias("t", "key")), ["t", "key"]).select("node", "centre").distinct()
    placed = seen.join(nodes.select("node", "raw", "d"), "node").join(kept.select("centre", "n", "unit", F.col("d").alias("e")), "centre").where("d = e")
    half = math.cos(math.acos(threshold) / 2 - 1e-7)
    inside = placed.select("node", "centre", "n", "raw", "unit", "d").mapInArrow(_within(half), "node long, centre long, n long")
    out = materialize(inside.groupBy("node").agg(F.min_by("centre", F.struct(-F.col("n"), "centre")).alias("ball")), "inside")
    discard(crowded, centres, kept)
    return out


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """Plan of buckets over ``block`` rows: balls with at least an eighth of a block have blocks of their own (``ball`` -1: the rest)."""
    sizes = members.select("ball", F.posexplode("keys").alias("t", "key")).groupBy("t", "key", "ball").agg(F.count(F.lit(1)).alias("c"))
    large = split_join(sizes, sizes.groupBy("t", "key").agg(F.sum("c").alias("m")).where(F.col("m") > block).select("t", "key"), ["t", "key"])
    kind = F.when(F.col("c") >= block // 8, F.col("ball")).otherwise(F.lit(-1).cast("long"))
    classes = large.groupBy("t", "key", kind.alias("ball")).agg(F.ceil(F.sum("c") / block).cast("int").alias("b"))
    return classes.groupBy("t", "key").agg(F.array_sort(F.collect_list(F.struct("ball", "b"))).alias("classes"))


def _tasks(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``block``, ``low`` and ``high``: one task for a small bucket, pairs of blocks of a large one, without two blocks of one ball."""
    planned = split_join(rows, plan, ["t", "key"], "left")
    total = F.aggregate("classes", F.lit(0), lambda s, c: s + c["b"])
    before = lambda ball: F.aggregate("classes", F.lit(0), lambda s, c: s + F.when(c["ball"] < ball, c["b"]).otherwise(0))
    known = F.when(F.exists("classes", lambda c: c["ball"] == F.col("ball")), F.col("ball")).otherwise(F.lit(-1).cast("long"))
    own = F.element_at(F.filter("classes", lambda c: c["ball"] == F.col("class")), 1)["b"]
    cut = planned.withColumn("class", known).withColumn("start", before(F.col("class"))).withColumn("width", own)
    cut = cut.withColumn("block", F.when(F.col("classes").isNull(), F.lit(0)).otherwise(F.col("start") + F.pmod(F.xxhash64("node"), F.col("width")).cast("int")))
    outside = lambda k: (F.col("class") < 0) | (k < F.col("start")) | (k >= F.col("start") + F.col("width"))
    others = F.when(F.col("classes").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), total - 1), outside))
    return cut.withColumn("other", F.explode(others)).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))


def near_duplicate_vectors(
    embeddings: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bucket: int = BUCKET,
    block: int = BLOCK,
    full: int = FULL,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Two rows link when the cosine of their vectors in double precision is ``threshold``
    or more; vectors of different lengths do not, and neither do vectors that are null,
    zero or empty or hold null or non-finite entries: they stand alone.  Every row is a
    vector of its own, also a repeated one.  ``component_id`` is the smallest id
    reachable; a null id is the greatest, and null where a row reaches nothing else.
    ``kept`` is whether the row's id is its component's (null ids are kept only alone).
    A link at the threshold is found with probability ``recall``, closer ones more
    surely; none below it is reported.  Columns other than id and vector are not read.
    """
    if not 0 < threshold < 1 or not 0 < recall < 1:
        raise ValueError("threshold and recall must be between 0 and 1")
    source = embeddings.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    lengths = source.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c")).collect()  # one row per length
    plans = {}
    for r in lengths:
        parts = parts_of(r["d"], r["c"], bucket)
        plans[r["d"]] = (parts, tables_for(r["d"], tuple(parts), threshold, recall))
    rows = source.mapInArrow(_described(plans), _NODE)
    folded = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), *[F.any_value(c).alias(c) for c in ("d", "raw", "code", "factor", "keys")])
    nodes = materialize(folded.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    balls = _balls(nodes, plans, threshold, full)
    alone = F.lit(-1).cast("long")
    if balls is None:
        members = nodes.withColumn("ball", alone)
        ties = None
    else:
        members = materialize(nodes.join(balls, "node", "left").withColumn("ball", F.coalesce("ball", alone)), "members")
        in_ball = members.where("ball >= 0")
        ties = in_ball.groupBy("ball").agg(F.sum("copies").alias("all"), F.min("node").alias("head"))
    plan = materialize(_blocks(members, block), "plan")
    found = []
    for start in range(0, max([t for _, t in plans.values()], default=0), AT_ONCE):
        wanted = (F.col("t") >= start) & (F.col("t") < start + AT_ONCE)
        met = members.select("node", "d", "ball", "copies", "raw", "code", "factor", "keys", F.posexplode("keys").alias("t", "key")).where(wanted)
        met = met.withColumn("before", F.slice("keys", 1, F.col("t"))).drop("keys")
        dealt = _tasks(met, plan.where(wanted)).select("t", "key", "low", "high", "block", "node", "d", "ball", "copies", "raw", "code", "factor", "before")
        dealt = dealt.repartition("t", "key", "low", "high").sortWithinPartitions("t", "key", "low", "high")
        found.append(materialize(dealt.mapInArrow(_met(threshold), "a long, b long, n long"), "met"))
    empty = embeddings.sparkSession.createDataFrame([], "a long, b long, n long")
    links = reduce(DataFrame.union, found, empty)
    edges = links.select("a", "b")
    counted = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    known = members.select("node", "h1", "h2", "copies", "least", "ball").join(counted, "node", "left")
    if ties is not None:
        ties = materialize(ties, "ties")
        edges = edges.union(split_join(in_ball.select("node", "ball"), ties, ["ball"]).select("node", "head"))
        known = split_join(known, ties.select("ball", "all"), ["ball"], "left")
    else:
        known = known.withColumn("all", F.lit(None).cast("long"))
    joined = components(edges, "vectors").select(F.col("id").alias("node"), "component")
    known = materialize(known.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    n_links = F.coalesce("linked", F.lit(0)) + F.coalesce(F.col("all"), F.col("copies")) - 1
    done = split_join(known.select("component", "h1", "h2", n_links.alias("n_links")), least, ["component"]).select("h1", "h2", "n_links", "component_id")
    every = source.mapInArrow(_digests, "id long, h1 long, h2 long")
    placed = split_join(every, materialize(done, "linked"), ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    real = lambda c: F.when(c != NO_ID, c)
    return placed.select(
        real(F.col("id")).alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        real(component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
