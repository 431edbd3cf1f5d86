"""Words of many texts at once, as numpy arrays, for use inside Spark tasks.

An Arrow batch is cut into slices of a few megabytes of text (a longer text is a
slice of its own), so the memory of a task follows the slice and its longest
text, never the batch or the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes handled at once.
SLICE_BYTES = 2 << 20
#: Bytes hashed at once inside a slice, which bounds the arrays of powers.
_HASH_BYTES = 1 << 19

_MULTIPLIER = 0x9E3779B97F4A7C15
#: Inverse of the multiplier modulo 2**64.
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (two xor-shift-multiply rounds)."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(256, dtype=np.uint64), 77)
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def _spaces() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of ``data[starts[i]:ends[i]]`` for ordered spans that do not overlap.

    ``values`` gives the 64-bit value of each element of ``data``, by default of each byte.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    values = _byte_values(False) if values is None else values
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _HASH_BYTES, side="right")))
        size = int(ends[j - 1]) - base
        running = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(values[data[base : base + size]] * _powers(_MULTIPLIER, size), out=running[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (running[e] - running[s]) * _powers(_INVERSE, size + 1)[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


@dataclass
class Words:
    """Words of a slice: ``doc`` is the row, spans are offsets into ``data``, ``first[d]:first[d+1]`` are the words of row d."""

    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends, _byte_values(lower))

    def text(self, d: int) -> bytes:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true values that do not cross a text boundary."""
    if not len(inside):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(inside)]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words_of(texts: pa.Array) -> Words:
    """Runs of bytes other than space and tab to carriage return."""
    data, offsets = text_bytes(texts)
    starts, ends = runs_of(~_spaces()[data], offsets)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    return Words(data, offsets, doc, starts, ends, first)


def windows(hashes: np.ndarray, doc: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each position on, and which positions have so many words in their text."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out = out * np.uint64(_MULTIPLIER) + hashes[j : j + n]
    return mix(out, seed + size), doc[:n] == doc[size - 1 :][:n]


def cuts(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges with at most ``limit`` bytes of text, or one row."""
    _, offsets = text_bytes(texts)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, min(stop, len(texts))
        start = min(stop, len(texts))


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut by :func:`cuts` on a text column."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        for start, stop in cuts(texts):
            yield batch.slice(start, stop - start)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys, from batches sorted by those keys; one group is held at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for a, b in zip(edges, edges[1:]):
            part = table.slice(a, b - a)
            if a == 0 and held and any(held[-1].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.concat_tables(held)
                held = []
            elif a > 0 and held:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def whole_keys(batches: Iterable[pa.RecordBatch], key: str, work: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """``work`` on tables that hold all rows of each key they contain, from batches sorted by ``key``."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            done = work(pa.concat_tables([*held, table.slice(0, cut)]))
            held = []
            if done is not None and done.num_rows:
                yield done
        held.append(table.slice(cut))
    if held:
        done = work(pa.concat_tables(held))
        if done is not None and done.num_rows:
            yield done


def same_as_before(*columns: np.ndarray) -> np.ndarray:
    """For sorted columns: whether a row equals the row before it in all of them."""
    same = np.ones(len(columns[0]), dtype=bool)
    if len(same):
        same[0] = False
    for c in columns:
        same[1:] &= c[1:] == c[:-1]
    return same
