"""Merkle fixity audit of WARC replicas.

Records become leaves in the order of their slots, parents hash the digests of
their children, and a root stands for a file.  Two replicas compare roots first
and descend only into branches that differ, so an audit of equal replicas reads
nothing but roots.  Levels are tables that shrink by the fan-out; no group is
larger than it, except where several records claim one slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import materialize

FILE_RECORDS = 1024
FANOUT = 16
_END = "\r\n"


def warc_record(url: Column, page_id: Column, payload: Column) -> Column:
    """Bytes of a WARC 1.1 resource record; null payload and address are empty."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(
        F.lit(f"WARC/1.1{_END}WARC-Type: resource{_END}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">{_END}WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"{_END}Content-Type: text/html{_END}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_END * 2),
    )
    return F.concat(head.cast("binary"), body, F.lit(_END * 2).cast("binary"))


def records(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """``(file, slot, page_id, length, digest)`` of the WARC records of ``pages(page_id, url, html)``.

    A file holds ``file_records`` consecutive ids, a slot is the place of the id in
    it, so that a lost record does not shift the others.  Pages without id go to
    file -1, to slots by a hash of their address.
    """
    page_id = F.col("page_id").cast("long")
    spread = F.pmod(F.xxhash64("url"), F.lit(1 << 40))
    record = warc_record(F.col("url"), page_id, F.col("html"))
    return pages.select(
        F.coalesce(F.floor(page_id / file_records), F.lit(-1)).cast("long").alias("file"),
        F.coalesce(F.pmod(page_id, F.lit(file_records)), spread).cast("long").alias("slot"),
        page_id.alias("page_id"),
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record, 256).alias("digest"),
    )


class MerkleForest:
    """Trees of the files of one replica: ``levels[0]`` has a row per slot, the last a root per file."""

    def __init__(self, records: DataFrame, fanout: int = FANOUT, depth: int | None = None):
        self.records = materialize(records, "records")
        leaves = self.records.groupBy("file", "slot").agg(F.array_sort(F.collect_list("digest")).alias("d"), F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("n"))
        leaves = leaves.select("file", F.col("slot").alias("node"), F.when(F.size("d") == 1, F.element_at("d", 1)).otherwise(F.sha2(F.array_join("d", ""), 256)).alias("digest"), "bytes", "n")
        self.levels = [materialize(leaves, "leaves")]
        if depth is None:
            top, depth = self.levels[0].agg(F.max("node")).first()[0] or 0, 0
            while top:
                top //= fanout
                depth += 1
        self.depth = depth
        for _ in range(depth):
            self.levels.append(materialize(self._parents(self.levels[-1], fanout), "nodes"))

    @staticmethod
    def _parents(level: DataFrame, fanout: int) -> DataFrame:
        """Digest of the ordered children with the bytes that their range covers."""
        children = F.array_sort(F.collect_list(F.struct("node", "digest", "bytes")))
        grouped = level.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("parent")).agg(children.alias("c"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        listed = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["bytes"].cast("string"), x["digest"])), ",")
        return grouped.select("file", F.col("parent").alias("node"), F.sha2(listed, 256).alias("digest"), "bytes", "n")


def audit(primary: MerkleForest, replica: MerkleForest, fanout: int = FANOUT) -> DataFrame:
    """``(file, page_id, kind, offset, length)`` of every record that differs.

    ``kind`` is ``changed``, ``missing`` (not in the replica) or ``extra``; offset
    and length are those of the record in the replica that has it, the primary
    first.  Records of one id count as one slot, whose records are all listed.
    Both forests need the same depth.  Equal replicas give no rows.
    """
    if primary.depth != replica.depth:
        raise ValueError("forests of different depth")
    open_ = None
    for k in range(primary.depth, -1, -1):
        a, b = primary.levels[k], replica.levels[k]
        if open_ is not None:
            below = lambda level: level.withColumn("parent", F.floor(F.col("node") / fanout).cast("long")).join(open_, ["file", "parent"], "left_semi").drop("parent")  # noqa: B023, E731
            a, b = below(a), below(b)
        pair = a.select("file", "node", F.col("digest").alias("da")).join(b.select("file", "node", F.col("digest").alias("db")), ["file", "node"], "full")
        differing = pair.where(~F.col("da").eqNullSafe(F.col("db")))
        if k:
            open_ = materialize(differing.select("file", F.col("node").alias("parent")), "branches")
            if open_.isEmpty():
                break
    kind = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra").otherwise("changed")
    slots = materialize(differing.select("file", F.col("node").alias("slot"), kind.alias("kind")), "slots")
    from_primary = _located(primary.records, slots.where("kind <> 'extra'"))
    from_replica = _located(replica.records, slots.where("kind = 'extra'"))
    return from_primary.unionByName(from_replica)


def _located(records: DataFrame, slots: DataFrame) -> DataFrame:
    """Offsets of the records at ``slots``; only files that have one are laid out."""
    affected = records.join(slots.select("file").distinct(), "file", "left_semi")
    order = Window.partitionBy("file").orderBy("slot", "digest")
    laid = affected.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    return laid.join(slots, ["file", "slot"]).select("file", "page_id", "kind", F.col("offset").cast("long").alias("offset"), "length")


def compare(primary: DataFrame, replica: DataFrame, file_records: int = FILE_RECORDS, fanout: int = FANOUT) -> DataFrame:
    """:func:`audit` of two tables of pages."""
    depth = 0
    while fanout**depth < file_records:
        depth += 1
    # slots of pages without id go beyond a file; their tree needs more levels
    if not primary.select("page_id").union(replica.select("page_id")).where("page_id is null").isEmpty():
        while fanout**depth < 1 << 40:
            depth += 1
    return audit(*(MerkleForest(records(p, file_records), fanout, depth) for p in (primary, replica)), fanout)
