"""Many patterns over many texts at a time, in numpy.

A pattern is cut at its ``%`` into segments.  All segments of all patterns are found in
one pass over the texts for each length, by hashes of runs of characters that are then
compared character by character.  Bit sets over the texts say which of them hold every
segment of a pattern; only there are the places of the segments compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import numpy as np

#: Marks of ``%`` and ``_``: lone surrogates, which no text holds.
_ANY, _ONE = "\ud801", "\ud800"
#: Between texts; no character has this code, and three codes fit one number.
_END = (1 << 21) - 1
#: Longest run found by its hash; longer segments are compared as a whole where theirs is found.
RUN = 16
#: Pairs of a pattern and a place or text looked at together.
_AT_ONCE = 1 << 21
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def like_segments(pattern: str) -> tuple[list[str], bool]:
    """Segments of a pattern that begins with ``%``, in order, and whether the last one must end the text."""
    if "\\" not in pattern:
        marked = pattern.replace("%", _ANY).replace("_", _ONE)
    else:
        out, i = [], 0
        while i < len(pattern):
            c = pattern[i]
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            else:
                c = {"%": _ANY, "_": _ONE}.get(c, c)
            out.append(c)
            i += 1
        marked = "".join(out)
    parts = marked.split(_ANY)
    return [p for p in parts if p], parts[-1] != ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _step(h: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` characters from those of ``n - 1`` and the last characters: exact up to three."""
    return c if n == 1 else h | (c << np.uint64(21 * (n - 1))) if n < 4 else h * _FACTOR + c


def _expanded(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges given by start and length: the number of the range, and the place, of each element."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class _Runs:
    """Runs of one length, sorted by hash, with a bit table that most other places of a text fail."""

    def __init__(self, runs: Sequence[str], n: int):
        codes = _codes("".join(runs)).reshape(-1, n).astype(np.uint64)
        h = codes[:, 0]
        for k in range(2, n + 1):
            h = _step(h, codes[:, k - 1], k)
        order = np.argsort(h, kind="stable")
        self.n, self.codes, self.h = n, codes[order].T.copy(), h[order]
        self.runs = [runs[i] for i in order]
        bits = min(22, max(10, int(len(runs)).bit_length() + 5))
        self.shift, self.table = np.uint64(64 - bits), np.zeros(1 << bits, dtype=bool)
        self.table[(self.h * _MIX) >> self.shift] = True
        self.same = bool(len(h) > 1 and (self.h[1:] == self.h[:-1]).any())

    def find(self, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the run and place, by run and then place."""
        at = np.flatnonzero(self.table[(h * _MIX) >> self.shift])
        values = h[at]
        run = np.searchsorted(self.h, values)
        run[run == len(self.h)] = 0
        hit = np.flatnonzero(self.h[run] == values)
        at, run = at[hit], run[hit]
        if self.same:  # different runs of equal hash
            found = np.searchsorted(self.h, h[at], side="right")
            of, run = _expanded(run, found - run)
            at = at[of]
        if self.n > 3:
            same = np.ones(len(at), dtype=bool)
            for k in range(self.n):
                same &= c[at + k] == self.codes[k][run]
            at, run = at[same], run[same]
        order = np.argsort(run.astype(np.uint16) if len(self.h) <= 1 << 16 else run, kind="stable")
        return run[order], at[order]


class Patterns:
    """Patterns given as :func:`like_segments`; ``find`` says which texts each of them fits."""

    def __init__(self, patterns: Sequence[tuple[list[str], bool]]):
        wild, keys = {}, {}
        for segment in {s for segments, _ in patterns for s in segments}:
            if _ONE in segment or len(segment) > RUN:
                run = max(segment.split(_ONE), key=len)
                if run:
                    wild[segment] = (segment.index(run), run[:RUN])
                    keys[run[:RUN]] = len(run[:RUN])
            else:
                keys[segment] = len(segment)
        by_length: dict[int, list[str]] = {}
        for run, n in keys.items():
            by_length.setdefault(n, []).append(run)
        self.runs = [_Runs(by_length[n], n) for n in sorted(by_length)]
        ids = {run: i for i, run in enumerate(r for rs in self.runs for r in rs.runs)}
        self.n_runs, sizes = len(ids), [len(r) for r in ids]
        # segments that are more than their run, by length: the run, where it stands in them, and their characters
        self.checked = []
        for n in sorted({len(segment) for segment in wild}):
            some = [segment for segment in wild if len(segment) == n]
            places = [(ids[wild[segment][1]], wild[segment][0]) for segment in some]
            self.checked.append((*np.array(places, dtype=np.int64).T, _codes("".join(some)).reshape(-1, n)))
            ids.update({segment: i for i, segment in enumerate(some, len(sizes))})
            sizes.extend([n] * len(some))
        self.n_found = len(sizes)
        for segments, _ in patterns:  # nothing but places for any character
            for s in segments:
                if s not in ids:
                    ids[s] = len(sizes)
                    sizes.append(len(s))
        self.sizes = np.array(sizes, dtype=np.int64)

        self.every = np.array([i for i, (s, _) in enumerate(patterns) if not s], dtype=np.int64)
        lone = [(ids[s[0]], i) for i, (s, end) in enumerate(patterns) if len(s) == 1 and not end]
        self.lone_segment, self.lone = np.array(sorted(lone), dtype=np.int64).reshape(-1, 2).T
        several: dict[tuple[int, bool], list[list[int]]] = {}
        for i, (s, end) in enumerate(patterns):
            if len(s) > 1 or s and end:
                several.setdefault((len(s), end), []).append([i, *[ids[x] for x in s]])
        self.several = [(np.array(rows, dtype=np.int64), end) for (_, end), rows in several.items()]
        used = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *[rows[:, 1:].ravel() for rows, _ in self.several]]))
        self.row = np.full(len(sizes), -1, dtype=np.int64)
        self.row[used] = np.arange(len(used))
        self.used = used

    def _places(self, c: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segment and place of all segments with a character of their own, by segment and then place."""
        h, n, first = None, 0, 0
        long, size = c.astype(np.uint64), len(c) - RUN
        segments, places = [], []
        for runs in self.runs:
            while n < runs.n:
                n += 1
                h = _step(h, long[n - 1 : n - 1 + size], n)
            run, at = runs.find(h, long)
            segments.append(run + first)
            places.append(at)
            first += len(runs.h)
        run, at = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (segments, places))
        start = np.searchsorted(run, np.arange(self.n_runs + 1))
        segments, places, first = [run], [at], self.n_runs
        for runs, offsets, codes in self.checked:
            n = start[runs + 1] - start[runs]
            parts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), _AT_ONCE), side="right")
            for x, y in pairwise([*parts, len(n)]):
                which, place = _expanded(start[runs[x:y]], n[x:y])
                found = at[place]
                begin, of = found - offsets[x:y][which], text[found]
                ok = (begin >= starts[of]) & (begin + codes.shape[1] <= ends[of])
                begin, which = begin[ok], which[ok] + x
                for j in range(codes.shape[1]):
                    wanted = codes[which, j]
                    ok = (c[begin + j] == wanted) | (wanted == ord(_ONE))
                    begin, which = begin[ok], which[ok]
                segments.append(which + first)
                places.append(begin)
            first += len(runs)
        return np.concatenate(segments), np.concatenate(places)

    def find(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(pattern, text)`` of every pattern and text that it fits, each pair once."""
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        starts = np.cumsum(lengths + 1) - lengths - 1
        ends = starts + lengths
        c = np.concatenate([_codes("\0".join(texts)), np.zeros(RUN + 1, dtype="<u4")])
        c[ends] = _END
        c[len(c) - RUN :] = _END
        text = np.repeat(np.arange(len(texts)), lengths + 1)
        segment, at = self._places(c, text, starts, ends)
        of = text[at]

        every = np.repeat(self.every, len(texts)), np.tile(np.arange(len(texts)), len(self.every))
        found = [every]
        # patterns of one segment: each text that holds it, once
        once = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), dtype=bool), (segment[1:] != segment[:-1]) | (of[1:] != of[:-1])]))
        start = np.searchsorted(segment[once], self.lone_segment)
        n = np.searchsorted(segment[once], self.lone_segment, side="right") - start
        which, pair = _expanded(start, n)
        found.append((self.lone[which], of[once[pair]]))
        for s, i in zip(self.lone_segment, self.lone, strict=True):
            if s >= self.n_found:
                roomy = np.flatnonzero(lengths >= self.sizes[s])
                found.append((np.full(len(roomy), i), roomy))

        if len(self.used):
            mine = once[self.row[segment[once]] >= 0]
            row, within = self.row[segment[mine]], of[mine]
            width = -(-len(texts) // 64) * 64
            bits = np.empty((len(self.used), width // 64), dtype=np.uint64)
            for x in range(0, len(bits), step := max(1, _AT_ONCE // width)):
                held = np.zeros((min(step, len(bits) - x), width), dtype=bool)
                some = slice(*np.searchsorted(row, (x, x + step)))
                held[row[some] - x, within[some]] = True
                bits[x : x + step] = np.packbits(held, axis=1).view(np.uint64)
            for s in self.used[self.used >= self.n_found]:
                roomy = np.zeros(width, dtype=bool)
                roomy[: len(texts)] = lengths >= self.sizes[s]
                bits[self.row[s]] = np.packbits(roomy).view(np.uint64)
            key = segment * len(c) + at
            for rows, end in self.several:
                for x in range(0, len(rows), step := max(1, _AT_ONCE // width)):
                    some = rows[x : x + step]
                    all_of = bits[self.row[some[:, 1]]]
                    for k in range(2, some.shape[1]):
                        all_of &= bits[self.row[some[:, k]]]
                    kept = np.flatnonzero(all_of.any(axis=1))
                    which, t = np.nonzero(np.unpackbits(all_of[kept].view(np.uint8), axis=1))
                    found.append(self._ordered(some[kept], end, which, t, starts, ends, key, at, of, len(c)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _ordered(self, rows, end, which, t, starts, ends, key, at, of, size):
        """The pairs whose segments stand one after the other: each taken at its first place, which leaves the most to the others."""
        begin = starts[t]
        for k in range(1, rows.shape[1]):
            s = rows[which, k]
            last = ends[t] - self.sizes[s]
            if end and k == rows.shape[1] - 1:
                ok = last >= begin
                begin = np.maximum(last, begin)
            else:
                ok = begin <= last
            hit = np.searchsorted(key, s * size + begin)
            hit[hit == len(key)] = 0
            if len(key):
                place = at[hit]
                there = (key[hit] == s * size + place) & (of[hit] == t) & (place >= begin)
                if end and k == rows.shape[1] - 1:
                    there &= place == begin
            else:
                there, place = np.zeros(len(s), dtype=bool), begin
            loose = s >= self.n_found
            ok &= there | loose
            begin = np.where(loose, begin, place) + self.sizes[s]
            which, t, begin = which[ok], t[ok], begin[ok]
        return rows[which, 0], t
