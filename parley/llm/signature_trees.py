"""N-gram Jaccard join with signature trees.

1. *Roots.*  A text's shingle set is cut into hash ranges whose number follows
   its size, so that two sets over the threshold agree on at least one whole
   range (more ranges than differences).  Texts that agree on a range share a
   root; one link to the smallest id of each root is enough to say so.  A slice of
   texts settles its own texts first: one that links with an earlier text, its
   leader, has the leader ask for its ranges, so that a range that a third of all
   texts has travels once per leader and slice.  What met under one smallest id is
   compared by token bitmaps, at the width that suits the smaller of two texts; texts
   connected by what may still link form a cluster.  Leaders of two linked texts are at most three distances ``1 -
   threshold`` apart (a text and its leader, the two texts, a text and its leader),
   so bitmaps are held to that, and every pair over the threshold lies within one
   cluster.
2. *Trees.*  Equal texts are folded into one.  The bitmaps of a group, and later
   the sets of a cluster, become leaves of a tree whose nodes hold the OR of their token bitmaps and their
   range of set sizes.  A dual traversal drops node pairs whose sizes are too
   far apart or whose greatest possible overlap is too small, and those whose
   leaves are linked already; what is left is compared exactly.
3. A root group or a cluster over a size bound is cut into blocks by size class; pairs
   of blocks whose sizes fit are trees of their own tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.tables import NO_ID, components, spanning, split_join
from parley.llm.words import groups, mix, same_as_before, slices, whole_keys, windows, words_of
from parley.session import discard, materialize

#: Shingles of one block of a cluster, 8 bytes each.
BLOCK_SHINGLES = 500_000
FANOUT = 8

#: Documents of one block of a root group.
GROUP_BLOCK = 4096

_EDGE, _ASK, _SIZE, _SHARED = 0, 1, 2, 3
_ROWS = "kind byte, key long, doc long, other long, bits binary"
_MET = "kind byte, key long, doc long, other long, mark long, holders long, bits binary"
#: Leaders a text is compared with in its slice, and leaders kept per range; a text that finds none of its own asks for itself.
_TRIED, _LED = 3, 4


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ASCII letters count as lower case."""
    words = words_of(texts)
    hashes = words.hashes(lower=True)
    full, valid = windows(hashes, words.doc, width, seed=41)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            out.append(windows(hashes[a:b], np.zeros(b - a), b - a, seed=43)[0])
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def range_plan(size_class: int, num: int, den: int) -> tuple[int, int]:
    """Ranges, and how many of them need no key, for sets whose smaller one has ``2**size_class`` to twice as many shingles.

    Sets a, b with ``den * |a & b| >= num * |a | b|`` differ in at most
    ``|a| * (den - num) / num`` shingles.  With so many more ranges, ``spare + 1`` of
    them are equal in both: a set may do without keys for ``spare`` of them, the empty
    ones first, then the most common ones.  0 ranges: only equal sets can link.
    """
    most = ((2 << size_class) - 1) * (den - num) // num
    if not most:
        return 0, 0
    spare = most // 20 + 3 + 4 + most // 6
    return most + 1 + spare, spare


def marked_keys(shingles: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set can meet all sets it may link with, and a mark for each.

    A mark is ``4 * n + kind``: of the keys of its kind the set can do without the
    ``n`` most common ones.
    """
    n = len(shingles)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    own = n.bit_length() - 1
    scrambled = mix(shingles, 47)
    running = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(scrambled, out=running[1:])
    keys = [mix(running[-1:] + np.uint64(n), 53)]  # equal sets
    marks = [2]
    for size_class in (own - 1, own):
        if size_class < 0 or size_class < own and ((1 << own) - 1) * den < n * num:
            continue
        ranges, spare = range_plan(size_class, num, den)
        if not ranges:
            continue
        step = (1 << 64) // ranges + 1
        edges = np.array([step * j for j in range(1, ranges)], dtype=np.uint64)
        cut = np.concatenate([[0], np.searchsorted(shingles, edges), [n]])
        inside = running[cut[1:]] - running[cut[:-1]]
        key = mix(inside + mix(np.arange(ranges, dtype=np.uint64), 1000 + size_class), 59)
        filled = cut[1:] > cut[:-1]
        empty = int(ranges - filled.sum())
        keys.append(key if empty > spare else key[filled])
        marks.append(4 * (0 if empty > spare else spare - empty) + size_class % 2)
    return np.concatenate(keys), np.repeat(np.array(marks), [len(k) for k in keys])


def root_keys(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys of :func:`marked_keys`."""
    return marked_keys(shingles, num, den)[0]


def less_common(table: pa.Table) -> pa.RecordBatch:
    """Links of each document to the smallest holder of the keys it keeps, from all its shared keys.

    In the order by holders, then by key, a document leaves out as many of the first keys
    of a kind as the least of its marks says.  Of the keys that two linked sets share,
    which are more than either leaves out, the last one is kept by both.
    """
    key, doc, other, mark, holders = (table.column(c).to_numpy() for c in ("key", "doc", "other", "mark", "holders"))
    order = np.lexsort((key, -holders, mark & 3, doc))
    doc, other, mark = doc[order], other[order], mark[order]
    start = np.flatnonzero(~same_as_before(doc, mark & 3))
    size = np.diff(np.append(start, len(doc)))
    rank = np.arange(len(doc)) - np.repeat(start, size)
    kept = rank >= np.repeat(np.minimum.reduceat(mark >> 2, start), size)
    a, b = _edges(doc[kept], other[kept])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["doc", "root"])


def bitmap(shingles: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Token bitmap of a set, with four to eight bits per shingle unless ``bits``, a power of two, is given."""
    bits = bits or 4 << int(np.clip(len(shingles), 64, 1 << 13) - 1).bit_length()
    out = np.zeros(bits // 64, dtype=np.uint64)
    at = (shingles % np.uint64(bits)).astype(np.int64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def _batch(kind: int, key, doc, other, bits=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), kind, dtype=np.int8)), pa.array(key.view(np.int64)), pa.array(doc), pa.array(other), pa.nulls(len(doc), pa.binary()) if bits is None else pa.array(bits, pa.binary())],
        names=["kind", "key", "doc", "other", "bits"],
    )


def _star(key: np.ndarray, doc: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by key and id, without repeats (the least mark stays), and where each key starts."""
    order = np.lexsort((mark, doc, key))
    key, doc, mark = key[order], doc[order], mark[order]
    fresh = ~same_as_before(key, doc)
    key, doc, mark = key[fresh], doc[fresh], mark[fresh]
    return key, doc, mark, np.flatnonzero(~same_as_before(key))


def _edges(doc: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = doc != least
    pairs = np.unique(np.stack([doc[far], least[far]]), axis=1)
    return pairs[0], pairs[1]


def _over(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    common = _overlap(a, b)
    return common * den >= num * (len(a) + len(b) - common)


def leaders_of(ids: np.ndarray, sets: list[np.ndarray], roots: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The leader of each text of a slice: a text over the threshold with it that leads itself, or the text itself.

    Equal sets have one leader, and only texts that share a root are compared.
    """
    leader = np.arange(len(ids))
    key = np.concatenate([*roots, np.zeros(0, dtype=np.uint64)])
    row = np.repeat(np.arange(len(ids)), [len(r) for r in roots])
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    shared = count[place] > 1
    place, row = place[shared], row[shared]
    edges = np.searchsorted(row, np.arange(len(ids) + 1))
    equal: dict[int, int] = {}
    led: dict[int, list[int]] = {}
    for i in np.lexsort((np.arange(len(ids)), ids)).tolist():
        if edges[i] == edges[i + 1]:
            continue
        first = equal.setdefault(int(roots[i][0]), i)
        if first != i:
            leader[i] = leader[first]
            continue
        own = place[edges[i] : edges[i + 1]].tolist()
        met: dict[int, int] = {}
        for k in own:
            for j in led.get(k, ()):
                met[j] = met.get(j, 0) + 1
        for j in sorted(met, key=lambda j: (-met[j], j))[:_TRIED]:
            if _over(sets[i], sets[j], num, den):
                leader[i] = j
                break
        else:
            for k in own:
                led[k] = [*led.get(k, ())[1 - _LED :], i]
    return leader


def _ask(width: int, num: int, den: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = batch.column("doc").to_numpy()
            sets = shingle_sets(batch.column("text"), width)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            yield _batch(_SIZE, ids.astype(np.uint64), ids, sizes, [bitmap(x).tobytes() if len(x) else None for x in sets])
            marked = [marked_keys(s, num, den) for s in sets]
            roots = [k for k, _ in marked]
            asking = ids[leaders_of(ids, sets, roots, num, den)]
            a, b = _edges(ids, asking)
            if len(a):
                yield _batch(_EDGE, a.astype(np.uint64), a, b)
            key = np.concatenate([*roots, np.zeros(0, dtype=np.uint64)])
            mark = np.concatenate([*(m for _, m in marked), np.zeros(0, dtype=np.int64)])
            key, doc, mark, _ = _star(key, np.repeat(asking, [len(r) for r in roots]), mark)
            order = np.argsort(doc, kind="stable")  # rows of one document side by side compress best
            yield _batch(_ASK, key[order], doc[order], mark[order])

    return work


def _meet(table: pa.Table) -> pa.RecordBatch:
    """Rows of keys that several documents ask for: the smallest of these, and how many they are; other rows as they are."""
    kind = table.column("kind").to_numpy()
    asked = kind == _ASK
    key, doc, mark, start = _star(*(table.column(c).to_numpy()[asked] for c in ("key", "doc", "other")))
    size = np.diff(np.append(start, len(key)))
    least, holders = np.repeat(doc[start], size), np.repeat(size, size)
    far = doc != least
    n = int(far.sum())
    names = ["kind", "key", "doc", "other", "mark", "holders", "bits"]
    shared = pa.table([pa.array(np.full(n, _SHARED, dtype=np.int8)), pa.array(key[far]), pa.array(doc[far]), pa.array(least[far]), pa.array(mark[far]), pa.array(holders[far]), pa.nulls(n, pa.binary())], names=names)
    passed = table.filter(pa.array(~asked))
    none = pa.nulls(len(passed), pa.int64())
    passed = pa.table([passed.column("kind"), none, passed.column("doc"), passed.column("other"), none, none, passed.column("bits")], names=names)
    out = pa.concat_tables([passed, shared]).combine_chunks()
    return out.to_batches()[0] if len(out) else pa.RecordBatch.from_arrays([c.combine_chunks() for c in out.columns], names=names)


def _compatible(num: int, den: int):
    """Of the documents of a root group, or of two of its blocks, links that connect whatever could reach ``num / den`` by its bitmap and size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["cluster", "low", "high"]):
            if table.num_rows < 2:
                continue
            table = table.combine_chunks()
            docs, n, block = (table.column(c).to_numpy() for c in ("doc", "n", "block"))
            low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
            raw = table.column("bits").to_pylist()
            width = np.array([len(b) // 8 for b in raw])
            found = [np.zeros((2, 0), dtype=np.int64)]
            widths = np.unique(width).tolist()

            def members(words: int, side: int | None) -> np.ndarray:
                own = np.flatnonzero((width == words) & ((block == side) if side is not None else True))
                return own[np.lexsort((docs[own], n[own]))]

            def tree(own: np.ndarray, words: int) -> Tree:
                return Tree(np.stack([folded(np.frombuffer(raw[i], dtype=np.uint64), words) for i in own]), n[own])

            def meet(left: np.ndarray, right: np.ndarray | None, words: int) -> None:
                if len(left) and (right is None or len(right)):
                    links = connecting(tree(left, words), None if right is None else tree(right, words), num, den)
                    ends = left if right is None else np.concatenate([left, right])
                    found.append(ends[links])

            for i, words in enumerate(widths):
                if low == high:
                    meet(members(words, None), None, words)
                for wider in widths[i:]:
                    if low != high:
                        meet(members(words, low), members(wider, high), words)
                    if wider != words:
                        meet(members(words, None if low == high else high), members(wider, None if low == high else low), words)
            links = np.concatenate(found, axis=1)
            if links.shape[1]:
                root = spanning(*links, len(docs))
                least = np.full(len(docs), np.iinfo(np.int64).max)
                np.minimum.at(least, root, docs)
                far = np.flatnonzero(docs != least[root])
                yield pa.RecordBatch.from_arrays([pa.array(docs[far]), pa.array(least[root][far])], names=["a", "b"])

    return work


def _sets(width: int):
    """The set of each document, once for each pair of blocks it takes part in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"), width)]
            rows = [(t["cluster"], t["low"], t["high"], t["block"], doc, s) for doc, s, tasks in zip(batch.column("doc").to_pylist(), sets, batch.column("tasks").to_pylist()) if s for t in tasks]
            for at in range(0, len(rows), 1000):
                columns = list(zip(*rows[at : at + 1000]))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], names=["cluster", "low", "high", "block", "doc", "shingles"]
                )

    return work


class Tree:
    """OR bitmaps, size ranges and greatest bitmap collisions, level by level; level 0 holds the leaves."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        self.levels = [(bitmaps, sizes, sizes, sizes - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            words, low, high, excess = self.levels[-1]
            at = np.arange(0, len(words), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(words, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))

    def __len__(self) -> int:
        return len(self.levels[0][0])


class _Forest:
    """Which labels are linked already."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, i: int) -> int:
        while (above := self.parent.get(i, i)) != i:
            i = above
        return i


def _stars(links: list[tuple[int, int]]) -> pa.RecordBatch:
    """The same components as links from every id to the smallest one."""
    ids = sorted({i for link in links for i in link})
    place = {i: k for k, i in enumerate(ids)}
    ends = np.array([(place[a], place[b]) for a, b in links], dtype=np.int64)
    pairs = [(i, ids[r]) for i, r in zip(ids, spanning(ends[:, 0], ends[:, 1], len(ids)).tolist())]
    far, near = zip(*[p for p in pairs if p[0] != p[1]] or [(ids[0], ids[0])])
    return pa.RecordBatch.from_arrays([pa.array(far, pa.int64()), pa.array(near, pa.int64())], names=["a", "b"])


def _may_link(left, right, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Node pairs whose sizes fit and whose greatest possible overlap is large enough."""
    (lw, llow, lhigh, lex), (rw, rlow, rhigh, rex) = left, right
    fits = (lhigh[x] * den >= rlow[y] * num) & (rhigh[y] * den >= llow[x] * num)
    keep = np.flatnonzero(fits)
    out = np.zeros(len(x), dtype=bool)
    step = max(1, (1 << 22) // lw.shape[1])
    for i in range(0, len(keep), step):
        at = keep[i : i + step]
        common = np.bitwise_count(lw[x[at]] & rw[y[at]]).sum(axis=1, dtype=np.int64) + np.minimum(lex[x[at]], rex[y[at]])
        most = np.minimum(common, np.minimum(lhigh[x[at]], rhigh[y[at]]))
        out[at] = most * (num + den) >= num * (llow[x[at]] + rlow[y[at]])
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def tree_links(sets: list[np.ndarray], split: int, num: int, den: int) -> np.ndarray:
    """Links that connect whatever pairs over the threshold connect.

    ``split`` 0 joins all sets with each other, otherwise those before ``split``
    with those from it on.
    """
    bits = 1 << int(np.clip(max(len(s) for s in sets) * 16, 512, 1 << 16) - 1).bit_length()
    maps, sizes = np.stack([bitmap(s, bits) for s in sets]), np.array([len(s) for s in sets])

    def over(a: int, b: int) -> bool:
        return _over(sets[a], sets[b], num, den)

    if split:
        return connecting(Tree(maps[:split], sizes[:split]), Tree(maps[split:], sizes[split:]), num, den, over)
    return connecting(Tree(maps, sizes), None, num, den, over)


def connecting(left: Tree, right: Tree | None, num: int, den: int, over: Callable[[int, int], bool] | None = None) -> np.ndarray:
    """Pairs of leaves for which ``over`` holds (without it: all that may link), enough to connect all that such pairs connect, by dual traversal.

    Leaves of ``right`` count on from those of ``left``; without it ``left`` meets
    itself.
    """
    split = len(left) if right else 0
    right = right or left
    links = [np.zeros((2, 0), dtype=np.int64)]
    labels = np.arange(split + len(right))
    stack = [(len(left.levels) - 1, len(right.levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        i, j, x, y = stack.pop()
        if len(x) > 1024:
            stack.append((i, j, x[1024:], y[1024:]))
            x, y = x[:1024], y[:1024]
        if i or j:  # children of the higher nodes
            if i >= j:
                x, y, i = *_children(x, y, len(left.levels[i - 1][0])), i - 1
            else:
                y, x, j = *_children(y, x, len(right.levels[j - 1][0])), j - 1
            if not split and i == j:
                x, y = x[x <= y], y[x <= y]
        if not i and not j:
            if not split:
                x, y = x[x < y], y[x < y]
            apart = labels[x] != labels[y + split]
            x, y = x[apart], y[apart]
        ok = _may_link(left.levels[i], right.levels[j], x, y, num, den)
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        if i or j:
            stack.append((i, j, x, y))
            continue
        made = _linked(x, y + split, labels, over)
        if made.shape[1]:
            links.append(made)
            labels = spanning(*labels[made], len(labels))[labels]
    return np.concatenate(links, axis=1)


def _linked(x: np.ndarray, y: np.ndarray, labels: np.ndarray, over: Callable[[int, int], bool] | None) -> np.ndarray:
    """Those of the pairs for which ``over`` holds, without such as these and ``labels`` connect already."""
    if over is None:
        return np.stack([x, y])
    forest, made = _Forest(), []
    for a, b, ra, rb in zip(x.tolist(), y.tolist(), labels[x].tolist(), labels[y].tolist()):
        ra, rb = forest.find(ra), forest.find(rb)
        if ra != rb and over(a, b):
            forest.parent[max(ra, rb)] = min(ra, rb)
            made.append((a, b))
    return np.array(made, dtype=np.int64).reshape(-1, 2).T


def _children(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    child = (x[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    return child[child < n], np.repeat(y, FANOUT)[child < n]


def _join(num: int, den: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["cluster", "low", "high"]):
            table = table.combine_chunks()
            low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
            blocks, docs = table.column("block").to_numpy(), table.column("doc").to_numpy()
            raw = table.column("shingles").to_pylist()
            # equal sets are one leaf per block
            leaves: dict[tuple, int] = {}
            equal: list[tuple[int, int]] = []
            for k in np.lexsort((docs, blocks)).tolist():
                first = leaves.setdefault((blocks[k], raw[k]), k)
                if first != k:
                    equal.append((docs[k], docs[first]))
            sets = {k: np.frombuffer(raw[k], dtype=np.uint64) for k in leaves.values()}
            # near copies mostly share their smallest shingle and differ little in size
            order = sorted(sets, key=lambda k: (blocks[k] != low, sets[k][0], len(sets[k]), docs[k]))
            split = sum(blocks[k] == low for k in order) if low != high else 0
            met = 0 < split < len(order) if low != high else len(order) > 1
            links = tree_links([sets[k] for k in order], split, num, den).T.tolist() if met else []
            ends = [(docs[order[a]], docs[order[b]]) for a, b in links] + (equal if low == high else [])
            if ends:
                yield _stars(ends)

    return work


def _blocked(members: DataFrame, num: int, den: int, most: int, weight: str = "n") -> DataFrame:
    """Add ``block``, ``low`` and ``high``: the pairs of blocks, of about ``most`` by ``weight``, that a document takes part in."""
    sums = members.groupBy("cluster").agg(F.sum(F.expr(weight)).alias("total"))
    large = materialize(sums.where(F.col("total") > most).select("cluster"), "large")
    whole = members
    for name in ("block", "low", "high"):
        whole = whole.withColumn(name, F.lit(0).cast("long"))
    if large.isEmpty():
        return whole
    whole = whole.join(large, "cluster", "left_anti")
    members = split_join(members, large, ["cluster"])
    width = float(np.log(den / num)) * 1.0001  # so that rounding keeps sizes that fit in neighbouring bands
    banded = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width).cast("long"))
    per_band = banded.groupBy("cluster", "band").agg(F.sum(F.expr(weight)).alias("weight"))
    near = per_band.select("cluster", (F.col("band") - 1).alias("band"), F.col("weight").alias("next"))
    before = per_band.select("cluster", (F.col("band") + 1).alias("band"), F.col("weight").alias("last"))
    plan = per_band.join(near, ["cluster", "band"], "left").join(before, ["cluster", "band"], "left")
    count = lambda c: F.coalesce(F.ceil(F.col(c) / most), F.lit(0)).cast("long")
    plan = plan.select("cluster", "band", count("weight").alias("here"), count("next").alias("above"), count("last").alias("below"))
    #: a block is band * 2**20 + its number within the band
    name = lambda band, k: band * (1 << 20) + k
    own = name(F.col("band"), F.pmod(F.xxhash64("doc"), F.col("here")))
    numbers = lambda n, band: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda k: name(band, k))).otherwise(F.array().cast("array<long>"))
    others = F.concat(
        numbers(F.col("here"), F.col("band")), numbers(F.col("above"), F.col("band") + 1), numbers(F.col("below"), F.col("band") - 1)
    )
    planned = split_join(banded, plan, ["cluster", "band"]).withColumn("block", own)
    met = planned.withColumn("other", F.explode(others))
    cut = met.select(*members.columns, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return whole.unionByName(cut)


def near_duplicates(
    docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per input row.

    Words are runs of bytes other than white space, ASCII letters in lower case.
    The set of a text is its distinct ``width`` word shingles, the whole sequence
    if it has fewer words, nothing if it has none (such texts link with nothing).
    Two texts link when ``den * |a & b| >= num * |a | b|``; ``component_id`` is the
    smallest id reachable by links.  Rows with one id are one node; rows without id
    are one node after all others, whose ``component_id`` is null when it links
    with nothing.  Columns other than id and text are not read.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold must be in (0, 1]")
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))
    asked = source.mapInArrow(_ask(width, num, den), _ROWS)
    dealt = asked.repartition(F.when(F.col("kind") == _ASK, F.xxhash64("key")).otherwise(F.xxhash64("doc", "other"))).sortWithinPartitions("key")
    met = materialize(dealt.mapInArrow(lambda b: whole_keys(b, "key", _meet), _MET), "roots", by=("kind",))
    pairs = materialize(_root_links(met, num, den), "pairs")
    clusters = components(pairs, "clusters")
    clusters = materialize(clusters.select(F.col("id").alias("doc"), F.col("component").alias("cluster")), "clusters")
    sizes = materialize(met.where(F.col("kind") == _SIZE).select("doc", F.col("other").alias("n_shingles")), "sizes")
    discard(met, pairs)
    leaders = materialize(_leaders(source, clusters), "leaders")
    links = materialize(_cluster_links(source, clusters, leaders, sizes, width, num, den, block_shingles), "links")
    discard(clusters)
    least = materialize(leaders.groupBy("doc").agg(F.min("leader").alias("least")), "least")
    same_id = leaders.join(least, "doc").where("leader <> least").select(F.col("leader").alias("a"), F.col("least").alias("b"))
    found = components(links.union(same_id), "links").select(F.col("id").alias("leader"), "component")
    placed = least.withColumnRenamed("least", "leader").join(found, "leader", "left").select("doc", F.coalesce("component", "leader").alias("component_id"))
    real = lambda c: F.when(c != NO_ID, c)
    return sizes.join(materialize(placed, "placed"), "doc", "left").select(
        real(F.col("doc")).alias("doc_id"), "n_shingles", real(F.coalesce("component_id", "doc")).alias("component_id")
    )


def _leaders(source: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(doc, leader)`` of documents in clusters: the smallest id with the same text, which alone needs comparing.

    An id with several texts has several leaders.
    """
    keyed = source.where("text is not null").select("doc", F.md5(F.col("text").cast("binary")).alias("h"), F.length("text").alias("l"))
    first = keyed.groupBy("h", "l").agg(F.min("doc").alias("leader"))
    same = split_join(keyed.join(clusters, "doc", "left_semi"), first, ["h", "l"])
    return same.select("doc", "leader").distinct()


def _root_links(met: DataFrame, num: int, den: int) -> DataFrame:
    """Links within root groups, a group being all that met under the same smallest id.

    Members are compared by their bitmaps, so that texts which share a passage and
    little else do not end in one cluster, a large group in blocks.  They are held to
    three times the distance of a link, as leaders stand for texts that link with
    them; where that excludes nothing, all links to the smallest id are kept.
    """
    num = 3 * num - 2 * den
    shared = met.where(F.col("kind") == _SHARED).select("key", "doc", "other", "mark", "holders").repartition("doc").sortWithinPartitions("doc")
    kept = shared.mapInArrow(lambda b: whole_keys(b, "doc", less_common), "doc long, root long")
    stars = materialize(met.where(F.col("kind") == _EDGE).select("doc", F.col("other").alias("root")).union(kept).distinct(), "stars")
    if num <= 0:
        return stars.select(F.col("doc").alias("a"), F.col("root").alias("b"))
    members = stars.union(stars.select(F.col("root").alias("doc"), "root").distinct()).withColumnRenamed("root", "cluster")
    described = met.where((F.col("kind") == _SIZE) & (F.col("other") > 0)).select("doc", F.col("other").alias("n"), "bits").distinct()
    known = materialize(members.join(described, "doc").select("cluster", "doc", "n", "bits"), "groups")
    dealt = _blocked(known, num, den, GROUP_BLOCK, "1").repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    return dealt.mapInArrow(_compatible(num, den), "a long, b long")


def _cluster_links(source, clusters, leaders, sizes, width, num, den, block_shingles) -> DataFrame:
    """Verified links between leaders of one cluster."""
    first = clusters.join(leaders.where("doc = leader").select("doc").distinct(), "doc", "left_semi")
    several = first.groupBy("cluster").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("cluster")
    members = split_join(first, several, ["cluster"]).join(sizes.groupBy("doc").agg(F.max("n_shingles").alias("n")), "doc")
    planned = _blocked(materialize(members, "members"), num, den, block_shingles)
    tasks = planned.groupBy("doc").agg(F.collect_list(F.struct("cluster", "low", "high", "block")).alias("tasks"))
    # texts are dealt by id at every size: a broadcast up to some size would only make costs jump there
    met = source.join(materialize(tasks, "tasks").hint("merge"), "doc")
    sets = met.mapInArrow(_sets(width), "cluster long, low long, high long, block long, doc long, shingles binary")
    dealt = sets.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    return dealt.mapInArrow(_join(num, den), "a long, b long")
