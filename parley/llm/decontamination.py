"""Benchmark decontamination with column expressions only.

Normalised windows of the benchmark become a bit set (a bounded literal).  A scan
hashes the token windows of every text and keeps those whose bit is set; these,
and only these, become rows, whose words are then compared with the benchmark's
windows themselves.  Texts are not shuffled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.bind import let
from parley.llm.mixing import row_hash
from parley.llm.tables import split_join
from parley.session import materialize

WINDOW = 10
#: Bytes between words, capitals being letters still.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most bits of the filter; beyond what it separates, more windows are compared.
MAX_BITS = 1 << 20
#: Windows of the benchmark that may be broadcast; more are joined by shuffling.
BROADCAST_WINDOWS = 500_000


def words(text: Column) -> Column:
    """Words of ASCII letters, digits and all characters beyond ASCII, letters as they are; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _GAPS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _windows(n: Column, size: int) -> Column:
    """Starts of windows of ``size`` words."""
    return F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))


def _hash(lowered: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.slice(lowered, at, F.lit(size)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, size, gram, hash)``: every window of every item; an item with fewer words is one window."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    items = items.withColumn("size", F.least("n", F.lit(window))).withColumn("l", F.transform("w", F.lower))
    starts = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)))
    gram = ascii_lower(F.array_join(F.slice("w", F.col("at"), F.col("size")), " "))
    return starts.select("item_id", "size", gram.alias("gram"), F.xxhash64(F.slice("l", F.col("at"), F.col("size"))).alias("hash")).distinct()


def _bit_set(grams: DataFrame, count: int) -> tuple[int, Column]:
    """Number of bits, and the set as a constant array of 64-bit words."""
    bits = 1 << 12
    while bits < min(MAX_BITS, 32 * count):
        bits *= 2
    place = F.pmod("hash", F.lit(bits))
    filled = grams.select(F.shiftright(place, 6).alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
    filled = filled.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("v"))
    by_word = {r["word"]: r["v"] for r in filled.collect()}  # at most MAX_BITS / 64 rows
    return bits, F.expr(f"cast(split('{','.join(str(by_word.get(i, 0)) for i in range(bits // 64))}', ',') as array<bigint>)")


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, spans, items, n_hit)``, one row per input row.

    ``spans`` are the (start, size) windows found, from word 1 on, ``items`` the
    ids found as sorted strings, ``n_hit`` the words inside a span.  Comparison is
    of whole words with ASCII letters in lower case.  Null, empty and word-less
    texts and items have no windows; an item without id marks words but is not
    listed; repeated items are one.  Other columns are not read.
    """
    grams = materialize(benchmark_windows(benchmark, window), "grams")
    sizes = {r["size"]: r["n"] for r in grams.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    count = sum(sizes.values())
    bits, bit_set = _bit_set(grams, count)

    def maybe(lowered: Column, at: Column, size: int) -> Column:
        return let(F.pmod(_hash(lowered, at, size), F.lit(bits)), lambda p: F.getbit(F.element_at(bit_set, (F.shiftright(p, 6) + 1).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)

    def of_size(w: Column, lowered: Column, size: int) -> Column:
        found = F.filter(_windows(F.size(lowered), size), lambda at: maybe(lowered, at, size))
        return F.transform(found, lambda at: F.struct(at.alias("start"), F.lit(size).alias("size"), F.array_join(F.slice(w, at, F.lit(size)), " ").alias("gram")))

    def candidates(w: Column) -> Column:
        if not sizes:
            return F.array().cast("array<struct<start:int,size:int,gram:string>>")
        return let(F.transform(w, F.lower), lambda lowered: F.concat(*[of_size(w, lowered, k) for k in sorted(sizes)]))

    scanned = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        let(words(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), candidates(w).alias("spans"))).alias("s"),
    )
    scanned = materialize(scanned.select("doc_id", "s.*", F.monotonically_increasing_id().alias("row")), "windows")
    spans = scanned.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s"))
    spans = spans.select("row", "s.start", "s.size", ascii_lower(F.col("s.gram")).alias("gram"))
    known = grams.select("item_id", "size", "gram")
    found = spans.join(F.broadcast(known) if count <= BROADCAST_WINDOWS else known, ["size", "gram"])
    per_row = found.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["size"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).cast("long").alias("n"),
    )
    per_row = per_row.withColumn("n_hit", F.aggregate("spans", start, step)["n"])
    joined = scanned.drop("spans").join(per_row, "row", "left")
    return joined.select("row", "doc_id", "n_words", F.coalesce("spans", F.array()).alias("spans"), F.coalesce("items", F.array()).alias("items"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"))


def digest(hits: DataFrame) -> DataFrame:
    """Counts and the SHA-256 of the item list."""
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text has no window of the benchmark, whatever other rows of their id have."""
    keyed = docs.withColumn("_row", row_hash(1, id_col, text_col))
    bad = find_hits(keyed, benchmark, window, "_row", text_col).where("n_hit > 0").select(F.col("doc_id").alias("_row")).distinct()
    return split_join(keyed, bad, ["_row"], "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def remove_spans(text: Column, spans: Column) -> Column:
    """Words outside the spans, joined by one space."""
    kept = lambda w: F.filter(w, lambda _, i: ~F.exists(spans, lambda s: (i + 1 >= s["start"]) & (i + 1 < s["start"] + s["size"])))
    return let(words(text), lambda w: F.array_join(kept(w), " "))
