"""Language identification with interpolated Kneser-Ney character models.

A text is its runs of letters in lower case; a run is read between boundary
marks, so the probability of a run does not depend on its neighbours and a slice
of texts scores each distinct run once.  Counts of all orders come from all
training texts, are added up by Spark and stay in Spark's tables, keyed by 64-bit
gram codes; nothing is cut.  A slice of the texts asks for its distinct grams and
gets them as sorted arrays of codes with log probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.quality import held_out
from parley.llm.words import hash_spans, mix, runs_of, slices
from parley.session import discard, materialize

ORDER = 4
#: Letters after which more text adds no more certainty to a score.
CERTAIN_LETTERS = 60
_PENDING = 1 << 20
#: Rows of a file that look up their grams together.
SLICE_ROWS = 1 << 14


class Alphabet:
    """Which code points are letters, and the 64-bit values of 16-bit letter codes; made once per task."""

    def __init__(self):
        self.letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        self.values = mix(np.arange(1 << 16, dtype=np.uint64), 61)


@dataclass
class Runs:
    """Letter runs: the row of each, its distinct run, and the gram codes of all distinct runs (``first`` marks where each starts)."""

    row: np.ndarray
    kind: np.ndarray
    letters: np.ndarray
    grams: np.ndarray
    first: np.ndarray


def letter_runs(texts: pa.Array, alphabet: Alphabet) -> Runs:
    lowered = [(t or "").lower() for t in texts.to_pylist()]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le"), dtype=np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered], dtype=np.int64)])
    starts, ends = runs_of(alphabet.letters[points], np.zeros(1, dtype=np.int64))
    codes = np.where(points < 0x10000, points, 0xE000 + points % 0x1900).astype(np.int64)  # 16 bits a letter
    _, at, kind = np.unique(hash_spans(codes, starts, ends, alphabet.values), return_index=True, return_inverse=True)
    size = ends[at] - starts[at]
    first = np.concatenate([[0], np.cumsum(size + 1)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], size + 1)
    base, length = np.repeat(starts[at], size + 1), np.repeat(size, size + 1)
    grams = np.zeros(first[-1], dtype=np.uint64)
    for back in range(ORDER - 1, -1, -1):
        i = place - back
        inside = (i >= 0) & (i < length)
        grams = (grams << np.uint64(16)) | np.where(inside, codes[np.where(inside, base + i, 0)] if len(codes) else 0, 0).astype(np.uint64)
    return Runs(np.searchsorted(begin, starts, side="right") - 1, kind, ends - starts, grams, first)


def _summed(lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((gram, lang))
    lang, gram, n = lang[order], gram[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])])[: len(lang)])
    return lang[start], gram[start], np.add.reduceat(n, start) if len(start) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alphabet = Alphabet()
    names: dict[str, int] = {}
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        lang, gram, n = _summed(*(np.concatenate(x) for x in zip(*held)))
        label = np.array(list(names), dtype=object)
        return pa.RecordBatch.from_arrays([pa.array(label[lang], pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for batch in slices(batches, "text"):
        runs = letter_runs(batch.column("text"), alphabet)
        langs = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()])
        repeat = np.diff(runs.first)
        for lang in np.unique(langs):
            seen = np.bincount(runs.kind[langs[runs.row] == lang], minlength=len(repeat))
            n = np.repeat(seen, repeat)
            held.append(_summed(np.full(int((n > 0).sum()), lang), runs.grams[n > 0], n[n > 0]))
        if sum(len(h[0]) for h in held) > _PENDING:
            held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
            if len(held[0][0]) > _PENDING // 2:
                yield flush()
                held = []
    if held:
        yield flush()


@dataclass
class Models:
    """Kneser-Ney models of all languages as tables; ``l`` is a place in ``names``.

    ``seen[k]`` has the probability ``p`` of the last letter of every learnt gram of
    ``k`` letters, ``back[k]`` the ``weight`` a context leaves to shorter grams.
    """

    names: list[str]
    #: Log probability of a letter never seen in a language.
    unseen: list[float]
    seen: dict[int, DataFrame]
    back: dict[int, DataFrame]

    def discard(self) -> None:
        discard(*self.seen.values(), *self.back.values())


def _shorter(gram, k: int):
    """The last ``k`` letters of a gram."""
    return gram.bitwiseAND(F.lit((1 << 16 * k) - 1))


def _context(gram):
    return F.shiftrightunsigned(gram, 16)


def train(docs: DataFrame) -> Models:
    """Models from ``(text, lang)`` rows with a language, whose names are in order.

    Counts, continuation counts (in how many longer grams a gram ends), discounts and
    contexts of all orders come from every gram.  Only the names of the languages and a
    number for each reach the driver.
    """
    counted = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(_count, "lang string, gram long, n long")
    counts = materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    models = Models(names, [], {}, {})
    if not names:
        return models
    place = (F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang")) - 1).cast("int")
    types = {ORDER: counts.select(place.alias("l"), "gram", "n")}
    for k in range(ORDER - 1, 0, -1):
        types[k] = materialize(types[k + 1].groupBy("l", _shorter(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    symbols = dict(types[1].groupBy("l").agg(F.count(F.lit(1))).collect())
    models.unseen = [-math.log(symbols[i] + 1) for i in range(len(names))]
    once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    for k in range(1, ORDER + 1):
        discount = F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.75)
        discounts = types[k].groupBy("l").agg(discount.alias("d"))
        grams = types[k].withColumn("context", _context(F.col("gram")))
        totals = grams.groupBy("l", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("size"))
        weighed = totals.join(discounts, "l").select("l", "context", "total", "d", (F.col("d") * F.col("size") / F.col("total")).alias("weight"))
        models.back[k] = materialize(weighed, "contexts")
        grams = grams.join(models.back[k], ["l", "context"])
        if k == 1:
            below = F.exp(F.get(F.array(*[F.lit(x) for x in models.unseen]), F.col("l")))
        else:
            lower = models.seen[k - 1].select("l", F.col("gram").alias("shorter"), F.col("p").alias("below"))
            grams = grams.withColumn("shorter", _shorter(F.col("gram"), k - 1)).join(lower, ["l", "shorter"])
            below = F.col("below")
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * below
        models.seen[k] = materialize(grams.select("l", "gram", p.alias("p")), "probabilities")
    discard(counts, *(types[k] for k in range(1, ORDER)))
    return models


def log_probabilities(grams: DataFrame, models: Models) -> DataFrame:
    """``(gram, h)``: log probability of the last letter of each distinct 4-gram, in every language.

    A gram that a language lacks has the probability of its shorter form times what
    its context leaves to it.
    """
    wanted = {ORDER: grams.select("gram").distinct()}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(_shorter(F.col("gram"), k).alias("gram")).distinct()
    by_language = lambda df, key, value: df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("l", value))).alias(value))
    places = F.sequence(F.lit(0), F.lit(len(models.names) - 1))
    done: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        asked = wanted[k].withColumn("context", _context(F.col("gram"))).join(by_language(models.seen[k], "gram", "p"), "gram", "left")
        asked = asked.join(by_language(models.back[k], "context", "weight"), "context", "left")
        if k == 1:
            asked = asked.withColumn("lower", F.array(*[F.lit(x) for x in models.unseen]))
        else:
            lower = done[-1].select(F.col("gram").alias("shorter"), F.col("h").alias("lower"))
            asked = asked.withColumn("shorter", _shorter(F.col("gram"), k - 1)).join(lower, "shorter")
        left_over = lambda i: F.coalesce(F.log(F.try_element_at("weight", i)), F.lit(0.0)) + F.get("lower", i)
        h = F.transform(places, lambda i: F.coalesce(F.log(F.try_element_at("p", i)), left_over(i)))  # noqa: B023
        done.append(materialize(asked.select("gram", h.alias("h")), "log-probabilities"))
    discard(*done[:-1])
    return done[-1]


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(slice, gram)``: what a slice of the texts has to look up."""
    alphabet = Alphabet()
    held: dict[int, list[np.ndarray]] = {}

    def merged(s: int) -> np.ndarray:
        return np.unique(np.concatenate(held[s]))

    def rows(s: int) -> pa.RecordBatch:
        grams = merged(s)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), s)), pa.array(grams.view(np.int64))], names=["slice", "gram"])

    for batch in slices(batches, "text"):
        number = batch.column("slice").to_numpy()
        grams = letter_runs(batch.column("text"), alphabet)
        for s in np.unique(number).tolist():
            mine = number[grams.row] == s
            used = np.zeros(len(grams.first) - 1, dtype=bool)
            used[grams.kind[mine]] = True
            held.setdefault(s, []).append(np.unique(grams.grams[np.repeat(used, np.diff(grams.first))]))
        for s in list(held):
            if len(held) > 1 and s not in number:  # rows of a slice stand together
                yield rows(s)
                del held[s]
            elif sum(map(len, held[s])) > _PENDING:
                held[s] = [merged(s)]
                if len(held[s][0]) > _PENDING // 2:
                    yield rows(s)
                    del held[s]
    for s in held:
        yield rows(s)


def _entropies(languages: int):
    """Cross-entropies of texts, which follow the sorted grams and log probabilities of their slice."""

    def scored(batch: pa.RecordBatch, keys: np.ndarray, logs: np.ndarray, alphabet: Alphabet) -> pa.RecordBatch:
        runs = letter_runs(batch.column("text"), alphabet)
        letters = np.bincount(runs.row, weights=runs.letters, minlength=batch.num_rows)
        symbols = np.bincount(runs.row, weights=runs.letters + 1, minlength=batch.num_rows)
        out = np.zeros((batch.num_rows, languages))
        if len(runs.grams):
            grams, place = np.unique(runs.grams, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            if not len(keys) or (keys[at] != grams).any():
                raise ValueError("the texts changed while they were read")
            found = logs[at]
            for k in range(languages):
                bits = np.add.reduceat(found[:, k][place], runs.first[:-1])
                out[:, k] = -np.bincount(runs.row, weights=bits[runs.kind], minlength=batch.num_rows) / np.maximum(symbols, 1)
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * languages)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), pa.array(letters.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))],
            names=["doc_id", "lang", "letters", "h"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet()
        current, parts = None, []
        keys, logs = np.zeros(0, dtype=np.uint64), np.zeros((0, languages))
        for batch in batches:
            number, is_text = batch.column("slice").to_numpy(), batch.column("is_text").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((number[1:] != number[:-1]) | (is_text[1:] != is_text[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(number)]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if number[a] != current:
                    current, parts = number[a], []
                    keys, logs = np.zeros(0, dtype=np.uint64), np.zeros((0, languages))
                if not is_text[a]:
                    h = piece.column("h").flatten().to_numpy(zero_copy_only=False).reshape(-1, languages)
                    parts.append((piece.column("gram").to_numpy().view(np.uint64), h))
                    continue
                if parts:
                    keys, logs = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(keys)
                    keys, logs, parts = keys[order], logs[order], []
                for texts in slices([piece], "text"):
                    yield scored(texts, keys, logs, alphabet)

    return work


def _sliced(source: DataFrame) -> DataFrame:
    """Add ``slice``: neighbouring rows of a file, or, where rows come from no file, rows that stood together when written."""
    block = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / SLICE_ROWS))
    try:
        return source.withColumn("slice", block)
    except AnalysisException:
        return materialize(source.withColumn("slice", F.spark_partition_id().cast("long")), "texts")


def entropies(source: DataFrame, models: Models) -> DataFrame:
    """``(doc_id, lang, letters, h)`` of ``source(doc_id, text, lang)``: cross-entropies per symbol in every language.

    What a slice of the texts looks up travels once per distinct gram, and comes back
    before its texts.
    """
    texts = _sliced(source)
    asked = materialize(texts.select("slice", "text").mapInArrow(_distinct_grams, "slice long, gram long").distinct(), "asked")
    known = log_probabilities(asked, models)
    told = asked.join(known, "gram").select(
        "slice", F.lit(False).alias("is_text"), "gram", F.col("h").cast("array<float>").alias("h"),
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("text"),
    )
    asking = texts.select(
        "slice", F.lit(True).alias("is_text"), F.lit(None).cast("long").alias("gram"), F.lit(None).cast("array<float>").alias("h"), "doc_id", "lang", "text"
    )
    met = told.unionByName(asking).repartition("slice").sortWithinPartitions("slice", "is_text")
    found = met.mapInArrow(_entropies(len(models.names)), "doc_id long, lang string, letters long, h array<double>")
    found = materialize(found, "entropies")
    discard(texts, asked, known)
    return found


def identify(docs: DataFrame, folds: int = 5, fold: int = 0, spread: float = 4.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, entropy, rejected)``, one row per input row.

    Learns from rows with a language whose CRC-32 of the id (as text) modulo
    ``folds`` is not ``fold``; rows without id are held out.  ``lang_pred`` has the
    lowest cross-entropy per symbol, the first by name among equals, ``und`` for
    texts without a letter or when nothing could be learnt.  ``score`` is the
    share of that language in the likelihoods, where length counts up to
    ``CERTAIN_LETTERS``.  ``rejected`` marks texts whose cross-entropy is over the
    mean of that language's training texts by ``spread`` standard deviations.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    out_of_training = held_out("doc_id", folds, fold)
    models = train(source.where(~out_of_training))
    names = models.names
    if not names:
        nothing = [F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("rejected")]
        return source.select("doc_id", out_of_training.alias("held_out"), *nothing)
    found = entropies(source, models)
    models.discard()
    scored = found.withColumn("held_out", out_of_training)
    known = F.col("letters") > 0
    lowest = F.array_min("h")
    certainty = F.least(F.col("letters"), F.lit(CERTAIN_LETTERS))
    spread_out = F.aggregate("h", F.lit(0.0), lambda a, x: a + F.exp((lowest - x) * certainty))
    labels = F.array(*[F.lit(n) for n in names])
    scored = scored.select(
        "doc_id",
        "held_out",
        "lang",
        F.when(known, F.element_at(labels, F.array_position("h", lowest).cast("int"))).otherwise("und").alias("lang_pred"),
        F.when(known, 1 / spread_out).otherwise(0.0).alias("score"),
        F.when(known, lowest).alias("entropy"),
    )
    usual = scored.where("not held_out and lang = lang_pred").groupBy("lang_pred").agg(F.avg("entropy").alias("m"), F.stddev_pop("entropy").alias("s")).collect()
    limit = F.lit(None).cast("double")
    for name, mean, deviation in usual:  # one row per learnt language
        limit = F.when(F.col("lang_pred") == name, mean + spread * deviation).otherwise(limit)
    return scored.select("doc_id", "held_out", "lang_pred", "score", "entropy", F.coalesce(F.col("entropy") > limit, F.lit(False)).alias("rejected"))
