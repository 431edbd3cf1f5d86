"""Quality rules on repetition inside a text, from a suffix array over its words.

The suffix array is built by prefix doubling on all texts of a slice at once;
ranks are places in the final order, so a suffix that is unique keeps its rank
and only suffixes in ties are sorted again.  The ranks of each doubling give the
longest common prefix of neighbours by halving.  LCP intervals of at least some
words are the maximal repeated substrings; the union of their spans is the
union, over positions, of the longest match of each suffix with a neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.words import Words, hash_spans, mix, runs_of, same_as_before, slices, words_of

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long"
)


def longest_matches(hashes: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each word position the longest word sequence that also starts elsewhere in its text, 0 where under ``least``."""
    n = len(hashes)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    ranks, ties = _word_ranks(hashes, doc)
    levels, length = [ranks], 1
    candidates = ties
    while len(ties):
        ranks, ties = _doubled(ranks, ties, doc, length)
        length *= 2
        levels.append(ranks)
        if length == 2 and least >= 2:
            candidates = ties
    order = candidates[np.argsort(ranks[candidates], kind="stable")]
    if len(order) < 2:
        return out
    common = _common_prefix(levels, order[:-1], order[1:])
    common[common < least] = 0
    out[order[:-1]] = common
    out[order[1:]] = np.maximum(out[order[1:]], common)
    return out


def _word_ranks(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each position's word among the sorted words of all texts, and the positions in ties."""
    keyed = hashes + mix(doc.astype(np.uint64), 17)  # one word in two texts is two words
    order = np.argsort(keyed, kind="stable")
    same = same_as_before(keyed[order])
    ranks = np.empty(len(keyed), dtype=np.int64)
    ranks[order] = np.maximum.accumulate(np.where(same, 0, np.arange(len(keyed))))
    tied = same.copy()
    tied[:-1] |= same[1:]
    return ranks, order[tied]


def _doubled(ranks: np.ndarray, ties: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by twice as many words; ``ties`` holds whole groups of equal ranks."""
    after = ties + length
    inside = after < len(ranks)
    inside[inside] = doc[after[inside]] == doc[ties[inside]]
    second = np.full(len(ties), -1, dtype=np.int64)
    second[inside] = ranks[after[inside]]
    order = np.lexsort((second, ranks[ties]))
    at, second = ties[order], second[order]
    first = ranks[at]
    same_group, same = same_as_before(first), same_as_before(first, second)
    place = np.arange(len(at))
    group = np.maximum.accumulate(np.where(same_group, 0, place))
    now = np.maximum.accumulate(np.where(same, 0, place))
    out = ranks.copy()
    out[at] = first + now - group
    tied = same.copy()
    tied[:-1] |= same[1:]
    return out, at[tied]


def _common_prefix(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    common = np.zeros(len(i), dtype=np.int64)
    n = len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + common, j + common
        inside = np.maximum(a, b) < n
        equal = np.zeros(len(i), dtype=bool)
        equal[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        common += equal.astype(np.int64) << k
    return common


def covered(matches: np.ndarray, least: int) -> np.ndarray:
    """Positions inside a match of at least ``least`` words."""
    steps = np.zeros(len(matches) + 1, dtype=np.int64)
    at = np.flatnonzero(matches >= least)
    steps[at] += 1
    np.add.at(steps, at + matches[at], -1)
    return np.cumsum(steps[:-1]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of word values by text."""
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return running[first[1:]] - running[first[:-1]]


def in_words(words: Words, mask: np.ndarray) -> np.ndarray:
    """Bytes of a kind inside the words of each text."""
    running = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return per_text(running[words.ends] - running[words.starts], words.first)


def repeated_lines(words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    starts, ends = runs_of(words.data != 0x0A, words.offsets)
    if not len(starts):
        return np.zeros(len(words.first) - 1, dtype=np.int64)
    word_before = np.searchsorted(words.starts, starts)
    has_word = word_before < np.searchsorted(words.starts, ends)
    starts, ends = starts[has_word], ends[has_word]
    doc = np.searchsorted(words.offsets, starts, side="right") - 1
    keyed = hash_spans(words.data, starts, ends) + mix(doc.astype(np.uint64), 19)
    order = np.argsort(keyed, kind="stable")
    return np.bincount(doc[order][same_as_before(keyed[order])], minlength=len(words.first) - 1)


def _measure(min_repeat: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = np.zeros(256, dtype=bool)
        symbol[list(SYMBOLS)] = True
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"))
            matches = longest_matches(words.hashes(), words.doc, least=3)
            longest = np.zeros(batch.num_rows, dtype=np.int64)
            np.maximum.at(longest, words.doc, matches)
            symbols = np.concatenate([[0], np.cumsum(symbol[words.data], dtype=np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")]
                + [
                    pa.array(np.asarray(x, dtype=np.int64))
                    for x in (
                        np.diff(words.first),
                        in_words(words, (words.data & 0xC0) != 0x80),
                        symbols[words.offsets[1:]] - symbols[words.offsets[:-1]],
                        repeated_lines(words),
                        per_text(covered(matches, 3), words.first),
                        per_text(covered(matches, min_repeat), words.first),
                        longest,
                    )
                ],
                names=[c.split()[0] for c in _SCHEMA.split(", ")],
            )

    return work


def repetition_rules(
    docs: DataFrame,
    min_repeat: int = 16,
    max_covered: float = 0.4,
    max_longest: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Measures and verdict of every text, one row per input row.

    ``covered_words`` are the words inside repeated substrings of at least
    ``min_repeat`` words, ``longest_repeat`` is the longest repeated substring (0
    under 3 words).  ``base_failed``: under 50 words, or more than half of the
    words in repeated 3-word windows.  ``kept`` is false if that is so, if
    ``covered_words`` exceeds ``max_covered`` of the words, or if
    ``longest_repeat`` exceeds ``max_longest``.  Null and empty texts have no
    words.  Other columns are not read; ids are passed on as they are.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    measured = source.mapInArrow(_measure(min_repeat), _SCHEMA)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    fine = (F.col("covered_words") <= F.col("n_words") * max_covered) & (F.col("longest_repeat") <= max_longest)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
