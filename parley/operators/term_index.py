"""Search for terms given as a table, by an inverted index of short character grams.

The index names the texts that hold each gram of one to three characters, and with them
the slices of sessions.  A term is looked for in those slices alone that hold all of its
grams; a term without any letter of its own (``%``) is led by the empty gram that every
text has.  In a slice, blocks of terms are tested together over its texts, read once
for each block, so neither candidates nor finds are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.arrow import slices
from parley.functions.bind import let
from parley.functions.patterns import Patterns, like_segments
from parley.operators.groups import SLICES, slice_mask, spread_slices, with_slice

#: Most grams looked up for a term, and how much more frequent than its rarest the others may be.
PROBES = 3
LESS_RARE = 4
#: Least number of tasks that cut texts to grams or gather candidates, for each core.
PER_CORE = 4
#: Terms tested together, and into how many parts (a divisor of the slices) texts are cut for each such block.
TERM_BLOCK = 1 << 17
PARTS = 24
#: Characters of the messages and fields of a session beyond which they are dealt out one by one.
SESSION_CHARS = 1 << 22
#: Characters, and texts, that a task looks through at a time, or one text.
_CHARS, _TEXTS = 1 << 17, 1 << 10

#: Lengths of grams; the longest that a term can fill leads to it.
_LENGTHS = (1, 2, 3)


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), PER_CORE * spark.sparkContext.defaultParallelism)


def search_units(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Everything a term can be found in: ``(kind, unit_id, session_id, text)``, one row per field and message.

    ``kind`` is ``message`` or ``own`` (title, id, visitor name and e-mail of a
    session); ``text`` is in lower case.  Missing fields are empty, missing messages
    match nothing and are left out.
    """
    fields = {"title": "title", "id": "session_id", "name": "visitor_name", "email": "visitor_email"}
    named = [
        F.struct(F.concat_ws(":", F.lit(name), F.col("session_id").cast("string")).alias("unit_id"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("text"))
        for name, c in fields.items()
    ]
    own = sessions.select(F.lit("own").alias("kind"), "session_id", F.explode(F.array(*named)).alias("u"))
    said = messages.where("content is not null").select(
        F.lit("message").alias("kind"), F.concat_ws(":", F.lit("message"), F.col("message_id").cast("string")).alias("unit_id"), "session_id", F.lower("content").alias("text")
    )
    return own.select("kind", "u.unit_id", "session_id", F.lower("u.text").alias("text")).unionByName(said)


def _grams(text: Column, n: int) -> Column:
    """Runs of ``n`` characters, in order; none if the text is shorter."""

    def of(chars: Column) -> Column:
        leading = F.slice(chars, 1, F.greatest(F.size(chars) - n + 1, F.lit(0)))
        return F.transform(leading, lambda c, at: F.concat(c, *[chars[at + k] for k in range(1, n)]))

    return let(F.split(text, ""), of)


def postings(units: DataFrame) -> DataFrame:
    """``(kind, gram, unit_id, session_slice)``: each unit once under each of its grams, and under the empty one."""
    every = F.concat(F.array(F.lit("")), *[_grams(F.col("text"), n) for n in _LENGTHS])
    sliced = with_slice(units, "session_id").withColumnRenamed("_slice", "session_slice")
    return sliced.select("kind", F.explode(F.array_distinct(every)).alias("gram"), "unit_id", "session_slice")


def like_pattern(term: Column) -> Column:
    """``%term%`` with its wildcards active; a backslash stays only before ``%``, ``_`` and itself."""
    return F.regexp_replace(F.concat(F.lit("%"), term, F.lit("%")), r"(?s)(\\[%_\\])|\\(.)", "$1$2")


def _literals(pattern: Column) -> Column:
    """Runs of a pattern between its wildcards, as the text must hold them."""
    runs = F.regexp_extract_all(pattern, F.lit(r"(?s)((?:\\.|[^%_\\])+)"), F.lit(1))
    return F.transform(runs, lambda r: F.regexp_replace(r, r"(?s)\\(.)", "$1"))


def _in_order(pattern: Column) -> Column:
    """A pattern as a regular expression that finds its pieces one after the other, each at its first place.

    The first place leaves the most text to the pieces after it, so none is ever tried
    again (``(?>``): a text is read once, where ``like`` tries every place of every piece.
    """
    escaped = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?s)^\\(.)", "$1"), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    marks = F.regexp_extract_all(pattern, F.lit(r"(?s)(\\.|.)"), F.lit(1))
    parts = F.transform(marks, lambda c: F.when(c == "%", ")(?>.*?").when(c == "_", ".").otherwise(escaped(c)))
    return F.concat(F.lit(r"(?s)\A(?>"), F.array_join(parts, ""), F.lit(r"\z)"))


def _wanted(terms: DataFrame) -> DataFrame:
    """``(term, kind, wanted, gram)``: the longest kind of gram each term offers, for messages and for own fields."""
    lowered = F.lower(like_pattern(F.col("term")))
    ways = F.array(
        F.struct(F.lit("message").alias("kind"), _in_order(lowered).alias("wanted"), _literals(lowered).alias("pieces")),
        F.struct(F.lit("own").alias("kind"), F.lower("term").alias("wanted"), F.array(F.lower("term")).alias("pieces")),
    )
    split = terms.select("term").where("term is not null").distinct().select("term", F.explode(ways).alias("w")).select("term", "w.*")
    of = lambda n: F.flatten(F.transform("pieces", lambda p: _grams(p, n)))
    offered = [of(n) for n in reversed(_LENGTHS)]
    best = F.coalesce(*[F.when(F.size(g) > 0, g) for g in offered], F.array(F.lit("")))
    return split.select("term", "kind", "wanted", F.explode(F.array_distinct(best)).alias("gram"))


def _by_postings(units: DataFrame, index: DataFrame, wanted: DataFrame, counts: DataFrame, probes: int) -> DataFrame:
    """``(term, session_id)`` by unit: each whose postings for a term's rarest grams are as many as these is tested in full."""
    offered = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "_mask")))
    rarest = wanted.join(counts, ["kind", "gram"], "left").groupBy("term", "kind", "wanted").agg(offered.alias("g")).where("g[0].n > 0")
    chosen = F.filter(F.slice("g", 1, probes), lambda x: x["n"] <= LESS_RARE * F.col("g")[0]["n"])
    picks = rarest.select("term", "kind", "wanted", chosen.alias("c")).select("term", "kind", "wanted", F.size("c").alias("need"), F.inline("c")).drop("n")
    # few bytes of terms lead to many candidates, so these are dealt out by number, not merged by size
    tasks, key = _tasks(wanted.sparkSession), ["kind", "gram", "_slice"]
    held = spread_slices(picks).repartition(tasks, *key).join(index.repartition(tasks, *key), key)
    candidates = held.groupBy("term", "kind", "wanted", "need", "unit_id").count().where("count = need")
    fits = F.when(F.col("kind") == "message", F.rlike("text", F.col("wanted"))).otherwise(F.contains("text", "wanted"))
    return candidates.join(units, ["kind", "unit_id"]).where(fits).select("term", "session_id")


class _Block:
    """The terms of a block and what has been found of them in the session read last."""

    def __init__(self, ways: list[tuple[str, str, str]]):
        names = {term: i for i, term in enumerate(dict.fromkeys(term for term, _, _ in ways))}
        self.terms = pa.array(names, pa.string())
        self.kinds = {}
        for kind in ("message", "own"):
            mine = [(names[term], pattern) for term, k, pattern in ways if k == kind]
            if mine:
                cut = like_segments if kind == "message" else lambda text: ([text] if text else [], False)
                self.kinds[kind] = np.array([i for i, _ in mine]), Patterns([cut(pattern) for _, pattern in mine])
        self.session, self.seen = None, np.zeros(len(names), dtype=bool)

    def find(self, rows: pa.Table, columns: list[str]) -> pa.Table:
        """Term and ``columns`` for each pair of a term and a session (all ``columns``) that no earlier call gave; sessions stand together."""
        sessions = [*zip(*(rows[c].to_pylist() for c in columns), strict=True)]
        starts = [i for i, x in enumerate(sessions) if not i or x != sessions[i - 1]]
        of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(sessions)]))
        kinds, texts = np.array(rows["kind"].to_pylist()), rows["text"].to_pylist()
        found = [np.empty(0, dtype=np.int64)]
        for kind, (numbers, patterns) in self.kinds.items():
            at = np.flatnonzero(kinds == kind)
            if len(at):
                pattern, text = patterns.find([texts[i] for i in at])
                found.append(np.unique(numbers[pattern] * len(starts) + of[at[text]]))
        term, session = np.divmod(np.unique(np.concatenate(found)), len(starts))
        if self.session != (sessions[0],):
            self.seen[:] = False
        new = (session > 0) | ~self.seen[term]
        if len(starts) > 1:
            self.seen[:] = False
        self.session = (sessions[-1],)
        self.seen[term[session == len(starts) - 1]] = True
        term, session = pa.array(term[new]), pa.array(np.array(starts)[session[new]])
        return pa.table([self.terms.take(term), *(rows[c].take(session) for c in columns)], ["term", *columns])


def _read(columns: list[str]):
    """Over cells, each its terms and then its units by session: what is found, a few hundred texts at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ways, block, held, chars = None, [], None, [], 0

        def found() -> Iterator[pa.RecordBatch]:
            if block and block.kinds and held:
                yield from block.find(pa.Table.from_batches(held).combine_chunks(), columns).to_batches(max_chunksize=1 << 16)

        for batch in slices(batches):
            cells, terms = batch["cell"].to_numpy(), batch["term"].is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (terms[1:] != terms[:-1])) + 1
            for x, y in pairwise([0, *cuts, len(cells)]):
                rows = batch.slice(x, y - x)
                if cells[x] != cell:
                    yield from found()
                    cell, ways, block, held, chars = cells[x], [], None, [], 0
                if terms[x]:
                    ways.extend(zip(*(rows[c].to_pylist() for c in ("term", "kind", "text")), strict=True))
                    continue
                if block is None:
                    block, ways = _Block(ways), []
                first = 0
                for i, size in enumerate(pc.utf8_length(rows["text"]).to_pylist()):
                    if chars and (chars + size > _CHARS or sum(map(len, held)) + i - first >= _TEXTS):
                        held.append(rows.slice(first, i - first))
                        yield from found()
                        held, chars, first = [], 0, i
                    chars += size + 1
                held.append(rows.slice(first))
        yield from found()

    return work


def _found_in_cells(units: DataFrame, ways: DataFrame, columns: list[str], blocks: int) -> DataFrame:
    """``term`` and ``columns`` by cells of a part of the units and a block of the terms.

    ``units``: part, kind, text and ``columns``; ``ways``: part, kind, text (the pattern) and
    term.  Within a cell no pair comes twice.
    """
    types = {f.name: f.dataType.simpleString() for f in units.schema}
    cell = lambda block: (F.col("part") * blocks + block).cast("int").alias("cell")
    asked = ways.select(cell(F.pmod(F.xxhash64("term"), F.lit(blocks))), "kind", "term", "text", *[F.lit(None).cast(types[c]).alias(c) for c in columns])
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    texts = units.withColumn("block", block).select(cell(F.col("block")), "kind", F.lit(None).cast("string").alias("term"), "text", *columns)
    dealt = asked.unionByName(texts).repartitionById(PARTS * blocks, "cell").sortWithinPartitions("cell", F.col("term").isNull(), *columns)
    return dealt.mapInArrow(_read(columns), ", ".join(["term string", *[f"`{c}` {types[c]}" for c in columns]]))


def search_terms(units: DataFrame, index: DataFrame, terms: DataFrame, probes: int = PROBES, beside: DataFrame | None = None) -> DataFrame:
    """``(term, session_id)`` of every session a term is found in; ``index`` holds the :func:`postings` of ``units``.

    Wildcards of a term work in message text and are literal elsewhere.  A term one
    of whose grams no text holds is found nowhere.  Texts are dealt out by session, so
    a session's finds meet in one task; sessions of much text are dealt out by unit.
    Units that share an id are led by the postings of their id, as one.  Terms that
    repeat count once, null ones are not looked for.

    ``beside`` (session_id and other columns) is joined: its sessions alone are
    given, with its columns.  Texts take these along, as they are fewer than the finds.
    """
    columns = ["session_id", *[c for c in (beside.columns if beside is not None else []) if c != "session_id"]]
    given = (lambda df: df.join(beside.distinct(), "session_id")) if beside is not None else (lambda df: df)
    index, units = index.withColumnRenamed("session_slice", "_slice"), units.where("text is not null")
    wanted, counts = _wanted(terms), index.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("n"), slice_mask())
    blocks = max(1, -(-terms.where("term is not null").select("term").distinct().count() // TERM_BLOCK))

    held = wanted.select("term", "kind", "gram").join(counts, ["kind", "gram"], "left").groupBy("term", "kind")
    places = held.agg(F.min(F.coalesce("n", F.lit(0))).alias("n"), F.bit_and("_mask").alias("_mask")).where("n > 0")
    pattern = F.when(F.col("kind") == "message", F.lower(like_pattern(F.col("term")))).otherwise(F.lower("term"))
    every = F.sequence(F.lit(0), F.lit(SLICES - 1))
    ways = lambda of: places.withColumn("text", pattern).withColumn("part", F.explode(F.array_distinct(F.transform(of, lambda i: i % PARTS))))
    in_mask = F.filter(every, lambda i: F.call_function("getbit", F.col("_mask"), i) == 1)

    shared = units.groupBy("kind", "unit_id").count().where("count > 1").select("kind", "unit_id")
    apart = units.groupBy("session_id").agg(F.sum(F.length("text")).alias("chars")).where(f"session_id is null or chars > {SESSION_CHARS}").select("session_id")
    repeated = not shared.isEmpty()
    if repeated:
        same_id = units.join(shared, ["kind", "unit_id"], "left_semi")
        apart = apart.union(same_id.select("session_id")).distinct()
    by_session = lambda df: with_slice(df, "session_id").withColumn("part", F.col("_slice") % PARTS)
    if apart.isEmpty():
        return _found_in_cells(by_session(given(units)), ways(in_mask), columns, blocks)
    those = lambda how: units.alias("u").join(apart.alias("a"), F.expr("u.session_id <=> a.session_id"), how)
    found = _found_in_cells(by_session(given(those("left_anti"))), ways(in_mask), columns, blocks)
    lone = those("left_semi")
    if repeated:
        lone = lone.join(shared, ["kind", "unit_id"], "left_anti")
    by_unit = given(lone).withColumn("part", F.pmod(F.xxhash64("kind", "unit_id"), F.lit(PARTS)))
    single = _found_in_cells(by_unit, ways(every), columns, blocks)
    if repeated:
        single = single.unionByName(given(_by_postings(same_id, index.join(shared, ["kind", "unit_id"], "left_semi"), wanted, counts, probes)).select("term", *columns))
    return found.unionByName(single.distinct())


class TermIndex:
    """Units and their postings in a folder, added to batch by batch.

    A batch is a folder of its own: writing one again replaces it, so a broken or
    repeated run leaves nothing twice.  Units of different batches must differ.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, units: DataFrame, batch: str) -> None:
        """Index ``units`` as ``batch``; postings of a gram are stored near each other."""
        tasks = _tasks(self.spark)
        units.repartition(tasks).write.mode("overwrite").parquet(f"{self.path}/units/batch={batch}")
        # small files would be read together, and a task would hold the postings of many texts
        stored = self.spark.read.schema(units.schema).parquet(f"{self.path}/units/batch={batch}").repartition(tasks)
        postings(stored).sortWithinPartitions(F.xxhash64("kind", "gram")).write.mode("overwrite").parquet(f"{self.path}/postings/batch={batch}")

    def search(self, terms: DataFrame, probes: int = PROBES, beside: DataFrame | None = None) -> DataFrame:
        """:func:`search_terms` over all batches."""
        read = lambda part: self.spark.read.parquet(f"{self.path}/{part}").drop("batch")
        return search_terms(read("units"), read("postings"), terms, probes, beside)
