"""Removing passages that an earlier document has, by level-wise doubling of windows.

Only windows that repeat at one length are looked at again at twice that length
(the last step ends at the wanted length), until the length is reached or no
candidate is left.

* At the first length every window of the wanted length is stood for by the
  smallest hash among its shorter windows.  Equal windows have equal
  stand-ins, and neighbours mostly share one, so few rows travel.
* A slice of texts settles what it can by itself: only the earliest document of
  a slice asks for a key, the others are answered at once.  A key that is in a
  third of all documents thus travels once per slice, not once per document.
* Answers go back to documents as lists of keys of one document, never as lists
  of documents of one key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.tables import NO_ID
from parley.llm.words import mix, same_as_before, slices, whole_keys, windows, words_of
from parley.session import materialize

_ROWS = "key long, tag int, doc long, kind byte"
_ASK, _SURE, _TOLD = 0, 1, 2


def lengths(window: int) -> list[int]:
    """Window lengths of the levels: doubled from about a quarter to half of ``window`` up to it."""
    out = [window]
    while out[0] > 8:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _stand_ins(hashes: np.ndarray, doc: np.ndarray, short: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest hash of the ``short`` word windows inside each ``window`` words, and which positions are valid."""
    parts, _ = windows(hashes, doc, short, seed=5)
    n = max(0, len(hashes) - window + 1)
    least = parts[:n].copy()
    for j in range(1, window - short + 1):
        np.minimum(least, parts[j : j + n], out=least)
    return least, doc[:n] == doc[window - 1 :][:n]


def _rows(key, tag, doc, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(tag.astype(np.int32)), pa.array(doc), pa.array(kind.astype(np.int8))],
        names=["key", "tag", "doc", "kind"],
    )


def _pre_answer(key: np.ndarray, tag: np.ndarray, doc: np.ndarray, later_only: bool) -> pa.RecordBatch:
    """One question per key from its earliest document; the other documents of the slice are answered."""
    order = np.lexsort((doc, tag, key))
    key, tag, doc = key[order], tag[order], doc[order]
    fresh = ~same_as_before(key, tag, doc)
    key, tag, doc = key[fresh], tag[fresh], doc[fresh]
    again = same_as_before(key, tag)
    kind = np.where(again, _TOLD, _ASK)
    if not later_only:
        shared = np.zeros(len(key), dtype=bool)
        shared[:-1] = again[1:]
        kind[~again & shared] = _SURE
    return _rows(key, tag, doc, kind)


def _answer(table: pa.Table, later_only: bool) -> pa.RecordBatch:
    """Documents whose key another document has (``later_only``: an earlier one)."""
    key, tag, doc, kind = (table.column(c).to_numpy() for c in ("key", "tag", "doc", "kind"))
    told = kind == _TOLD
    k, g, d, sure = key[~told], tag[~told], doc[~told], kind[~told] == _SURE
    order = np.lexsort((d, g, k))
    k, g, d, sure = k[order], g[order], d[order], sure[order]
    start = np.flatnonzero(~same_as_before(k, g))
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(k))))
    if not len(k):
        hit = np.zeros(0, dtype=bool)
    elif later_only:
        hit = d > d[start][group]
    else:
        hit = np.logical_or.reduceat(sure, start)[group] | (np.maximum.reduceat(d, start) > d[start])[group]
    out_key, out_doc = np.concatenate([key[told], k[hit]]), np.concatenate([doc[told], d[hit]])
    return pa.RecordBatch.from_arrays([pa.array(out_doc), pa.array(out_key)], names=["doc", "key"])


def _settle(asked: DataFrame, later_only: bool) -> DataFrame:
    """Meet the questions of a key; answers already given are dealt out by document."""
    dealt = asked.repartition(F.when(F.col("kind") == _TOLD, F.xxhash64("doc", "key")).otherwise(F.xxhash64("key", "tag")))
    work = lambda batches: whole_keys(batches, "key", lambda t: _answer(t, later_only))
    return dealt.sortWithinPartitions("key").mapInArrow(work, "doc long, key long")


def _of_document(answers: DataFrame) -> DataFrame:
    """Keys of each document, at most one per word."""
    return answers.groupBy("doc").agg(F.collect_list("key").alias("keys"))


def _members(values: np.ndarray, row: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Whether ``values[i]`` is among the keys of its row."""
    offsets = keys.offsets.to_numpy()
    flat = keys.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
    owner = np.repeat(np.arange(len(keys)), np.diff(offsets))
    salt = lambda r: mix(r.astype(np.uint64), 3)
    return np.isin(values + salt(row), flat + salt(owner))


def _level_tag(hashes, doc, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, further 32 bits of another hash, and validity of the windows of ``length`` words."""
    key, valid = windows(hashes, doc, length, seed=9)
    other, _ = windows(mix(hashes, 21), doc, length, seed=31)
    return key, (other >> np.uint64(33)).astype(np.int64), valid


def _candidates(short: int, window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, ids = words_of(batch.column("text")), batch.column("doc").to_numpy()
            least, valid = _stand_ins(words.hashes(), words.doc, short, window)
            row = words.doc[: len(least)]
            key, row = least[valid], row[valid]
            fresh = ~same_as_before(key, row)
            key, row = key[fresh], row[fresh]
            yield _pre_answer(key, np.zeros(len(key), dtype=np.int64), ids[row], later_only=False)

    return work


def _alive(hashes, doc, keys, levels, window) -> np.ndarray:
    """Windows of ``window`` words whose windows of the last level all survived."""
    if levels == 1:
        least, valid = _stand_ins(hashes, doc, lengths(window)[0], window)
        return valid & _members(least, doc[: len(least)], keys)
    length = lengths(window)[levels - 1]
    key, valid = windows(hashes, doc, length, seed=9)
    alive = valid & _members(key, doc[: len(key)], keys)
    n = max(0, len(hashes) - window + 1)
    inside = doc[:n] == doc[window - 1 :][:n]
    return inside & alive[:n] & alive[window - length : window - length + n]


def _extend(levels: int, window: int):
    """Windows of the next length in places where the last one survived."""
    length = lengths(window)[levels]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, ids = words_of(batch.column("text")), batch.column("doc").to_numpy()
            hashes = words.hashes()
            wanted = _alive(hashes, words.doc, batch.column("keys"), levels, window)
            key, tag, valid = _level_tag(hashes, words.doc, length)
            take = np.zeros(len(key), dtype=bool)
            for shift in range(window - length + 1):
                part = take[shift : shift + len(wanted)]
                part |= wanted[: len(part)]
            take &= valid
            yield _pre_answer(key[take], tag[take], ids[words.doc[: len(key)][take]], later_only=length == window)

    return work


def _finish(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"))
            hit = np.zeros(len(words.doc) + 1, dtype=np.int64)
            if len(batch.column("keys").values):
                key, valid = windows(words.hashes(), words.doc, window, seed=9)
                at = np.flatnonzero(valid & _members(key, words.doc[: len(key)], batch.column("keys")))
                np.add.at(hit, at, 1)
                np.add.at(hit, at + window, -1)
            gone = np.cumsum(hit[:-1]) > 0
            out = []
            for d in range(batch.num_rows):
                a, b = words.first[d], words.first[d + 1]
                tokens = words.text(d).split()
                drop = gone[a:b]
                kept = b" ".join([t for t, x in zip(tokens, drop.tolist()) if not x] if drop.any() else tokens)
                out.append((len(tokens), int(drop.sum()), kept.decode("utf-8", "replace")))
            n, removed, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc", "n_words", "n_removed", "kept_text"],
            )

    return work


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)``: texts without what smaller ids already say.

    A word goes if a window of ``window`` words that covers it starts also in a
    document with a smaller id; windows are judged on the input.  Kept words are
    joined by one space.  Null and empty texts have no words.  Rows with one id
    are one document, rows without id come after all others and are one document
    too.  Columns other than id and text are not read.  An empty table gives an
    empty result.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))
    levels = lengths(window)
    if len(levels) == 1:
        raise ValueError("the window must be over 8 words")
    found = materialize(_settle(source.mapInArrow(_candidates(levels[0], window), _ROWS), later_only=False), "repeats")
    for level in range(1, len(levels)):
        if found.isEmpty():
            break
        meeting = source.join(_of_document(found), "doc")
        asked = meeting.mapInArrow(_extend(level, window), _ROWS)
        found = materialize(_settle(asked, later_only=levels[level] == window), "repeats")
    done = source.join(_of_document(found), "doc", "left").mapInArrow(_finish(window), "doc long, n_words long, n_removed long, kept_text string")
    return done.withColumn("doc", F.when(F.col("doc") != NO_ID, F.col("doc"))).withColumnRenamed("doc", "doc_id")


def digest(texts: DataFrame) -> DataFrame:
    """Replace ``kept_text`` by its SHA-256."""
    return texts.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
