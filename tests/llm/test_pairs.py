"""N-gram Jaccard join and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import signature_trees, substring, tables as op_tables
from tests.conftest import SMALL
from tests.llm import tables

LAST = op_tables.NO_ID


def shingles(text, width):
    words = tables.WORD.findall((text or "").translate(tables.LOWER))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def linked(rows, width, num, den):
    """Sorted (id, set size, component) of all rows, by comparing all pairs."""
    sets = [(LAST if i is None else i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    real = lambda i: None if i == LAST else i
    return sorted(((real(i), len(s), real(find(i))) for i, s in sets), key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width, num, den", [(3, 90, 100), (5, 8, 10)])
def test_join_on_documents(spark, width, num, den):
    docs = tables.documents(spark, SMALL)
    rows = tables.rows_of(docs)
    assert found(signature_trees.near_duplicates(docs, width, num, den)) == linked(rows, width, num, den)


def near_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10_000)}"
        out.append((i * 3 % 1009, " ".join(copy), None, "s", 0))
    return out


@pytest.mark.parametrize("block", [signature_trees.BLOCK_SHINGLES, 700])
def test_join_in_a_large_group(spark, block):
    """Many near copies around the threshold, also with the cluster cut into blocks."""
    rows = near_copies(60, 60, 6, 1) + near_copies(40, 20, 2, 2) + tables.awkward()
    docs = tables.frame(spark, rows)
    got = found(signature_trees.near_duplicates(docs, 3, 80, 100, block_shingles=block))
    assert got == linked([r[:2] for r in rows], 3, 80, 100)


def test_join_of_nothing(spark):
    assert signature_trees.near_duplicates(tables.frame(spark, [])).count() == 0


def test_ranges_leave_an_equal_one():
    """Sets at the threshold share a key, whatever is taken away."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 127, 128, 129, 500, 3000]:
        for num, den in ((9, 10), (8, 10), (1, 2)):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            most = len(a) * (den - num) // num  # added ones
            b = np.unique(np.concatenate([a, rng.integers(0, 2**63, most, dtype=np.uint64)]))
            lost = int(len(a) - np.ceil(len(a) * num / den))
            c = np.delete(a, rng.choice(len(a), lost, replace=False)) if lost else a
            for other in (b, c):
                common = len(np.intersect1d(a, other))
                if den * common >= num * (len(a) + len(other) - common):
                    assert np.intersect1d(signature_trees.root_keys(a, num, den), signature_trees.root_keys(other, num, den)).size


def without_repeats(rows, window):
    rows = [(LAST if i is None else i, tables.WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in rows:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in rows:
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((None if i == LAST else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def removed(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(df).collect()), key=repr)


@pytest.mark.parametrize("window", [13, 30])
def test_repeats_on_documents(spark, window):
    docs = tables.documents(spark, SMALL)
    assert removed(substring.remove_repeats(docs, window)) == without_repeats(tables.rows_of(docs), window)


def test_repeats_in_awkward_rows(spark):
    rows = tables.awkward()
    assert removed(substring.remove_repeats(tables.frame(spark, rows))) == without_repeats([r[:2] for r in rows], 13)
    assert substring.remove_repeats(tables.frame(spark, [])).count() == 0


def test_levels_double_up_to_the_window():
    assert substring.lengths(13) == [7, 13]
    assert substring.lengths(50) == [7, 13, 25, 50]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in op_tables.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


def test_bitmaps_fold_to_those_of_fewer_bits():
    rng = np.random.default_rng(8)
    shingles = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for bits in (64, 128, 512):
        assert (signature_trees.folded(signature_trees.bitmap(shingles, 1024), bits // 64) == signature_trees.bitmap(shingles, bits)).all()


def test_large_root_groups_keep_their_links(spark, monkeypatch):
    """Root groups cut into blocks of bitmaps give the same components."""
    monkeypatch.setattr(signature_trees, "GROUP_BLOCK", 3)
    rows = near_copies(30, 60, 6, 4) + tables.awkward()
    assert found(signature_trees.near_duplicates(tables.frame(spark, rows), 3, 80, 100)) == linked([r[:2] for r in rows], 3, 80, 100)


def sharing_ranges(text, num, den, seed):
    """For each root range of a text of distinct words one unlike text that agrees with it there, at width 1."""
    hash_of = {w: int(h[0]) for w, h in zip(text.split(), signature_trees.shingle_sets(pa.array(text.split()), 1))}
    spare = [f"f{seed}x{i}" for i in range(4 * len(hash_of))]
    spare = {w: int(h[0]) for w, h in zip(spare, signature_trees.shingle_sets(pa.array(spare), 1))}
    ranges, _ = signature_trees.range_plan(len(hash_of).bit_length() - 1, num, den)
    step = (1 << 64) // ranges + 1
    out = []
    for j in range(ranges):
        inside = [w for w, h in hash_of.items() if h // step == j]
        others = [w for w, h in spare.items() if h // step != j]
        out.append(" ".join(inside + others[: len(hash_of) - len(inside)]))
    return out


def clustered(parts, num, den):
    """Clusters at width 1 of texts in slices, one a part, as the tasks of the join make them."""
    rows = []
    for part in parts:
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([t for _, t in part])], names=["doc", "text"])
        rows += signature_trees._ask(1, num, den)(iter([batch]))
    asked = pa.Table.from_batches(rows).sort_by("key")
    met = pa.Table.from_batches([signature_trees._meet(asked)])
    kept = signature_trees.less_common(met.filter(pa.array(met.column("kind").to_numpy() == signature_trees._SHARED)).sort_by("doc")).to_pylist()
    described, groups = {}, {}
    for r in met.to_pylist():
        if r["kind"] == signature_trees._SIZE:
            described[r["doc"]] = (r["other"], r["bits"])
        elif r["kind"] == signature_trees._EDGE:
            kept.append({"doc": r["doc"], "root": r["other"]})
    for r in kept:
        groups.setdefault(r["root"], {r["root"]}).add(r["doc"])
    members = pa.Table.from_pylist(
        [{"cluster": g, "doc": d, "n": described[d][0], "bits": described[d][1], "low": 0, "high": 0, "block": 0} for g, docs in sorted(groups.items()) for d in sorted(docs)]
    )
    root = {i: i for part in parts for i, _ in part}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for links in signature_trees._compatible(3 * num - 2 * den, den)(iter(members.to_batches())):
        for r in links.to_pylist():
            x, y = find(r["a"]), find(r["b"])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_links_beside_unlike_holders_of_every_shared_range():
    """A slice holds unlike texts with smaller ids for each range of a text, and they are not the smallest overall."""
    words = [f"a{i}" for i in range(100)]
    a, b = " ".join(words), " ".join([*words[:-8], *(f"b{i}" for i in range(8))])
    unlike, first = sharing_ranges(a, 8, 10, 1), sharing_ranges(a, 8, 10, 2)
    found = clustered([list(enumerate(first)), [*((1000 + i, t) for i, t in enumerate(unlike)), (2000, a)], [(3000, b)]], 8, 10)
    assert found[2000] == found[3000] == 2000


def test_links_between_texts_whose_leaders_do_not_link():
    """Two texts over the threshold, each in a slice that settles it under an earlier text; these differ by more."""
    words = [f"a{i}" for i in range(200)]
    swap = lambda t, at, tag: [f"{tag}{i}" if at <= i < at + 16 else w for i, w in enumerate(t)]
    a, b = words, swap(words, 0, "b")
    slices = [[(10, swap(a, 60, "c")), (500, a)], [(20, swap(b, 120, "d")), (600, b)]]
    found = clustered([[(i, " ".join(t)) for i, t in part] for part in slices], 8, 10)
    assert set(found.values()) == {10}


@pytest.mark.parametrize("num, den", [(8, 10), (1, 2)])
def test_links_among_texts_with_boilerplate_over_many_slices(spark, num, den):
    rng = random.Random(11)
    boilerplate = [f"p{i}" for i in range(60)]
    rows = []
    for family in range(40):
        base = boilerplate + [f"q{family}x{i}" for i in range(40)]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(10)):
                copy[rng.randrange(100)] = f"e{rng.randrange(100_000)}"
            rows.append((rng.randrange(1 << 40), " ".join(copy), None, "s", 0))
    docs = tables.frame(spark, rows).repartition(64)
    assert found(signature_trees.near_duplicates(docs, 1, num, den)) == linked([r[:2] for r in rows], 1, num, den)


def test_common_passages_do_not_connect_texts(spark):
    """Texts of mixed lengths with passages that most of them hold: links are kept, and no cluster outgrows its family."""
    rng = random.Random(5)
    passages = [[f"p{k}x{i}" for i in range(50)] for k in range(4)]
    rows = []
    for family in range(120):
        body = [f"q{family}x{i}" for i in range(rng.choice([150, 300, 800]))]
        for k in rng.sample(range(4), rng.randrange(1, 3)):
            at = rng.randrange(len(body))
            body[at:at] = passages[k]
        for _ in range(rng.choice([1, 1, 3])):
            copy = [f"e{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in body]
            rows.append((rng.randrange(1 << 40), " ".join(copy), None, "s", 0))
    docs = tables.frame(spark, rows).repartition(48)
    assert found(signature_trees.near_duplicates(docs, 3, 80, 100)) == linked([r[:2] for r in rows], 3, 80, 100)
    assert largest_cluster(spark, docs, 3, 80, 100) <= 12


def largest_cluster(spark, docs, width, num, den):
    source = docs.selectExpr("doc_id as doc", "text")
    asked = source.mapInArrow(signature_trees._ask(width, num, den), signature_trees._ROWS).repartition(1).sortWithinPartitions("key")
    met = asked.mapInArrow(lambda b: signature_trees.whole_keys(b, "key", signature_trees._meet), signature_trees._MET)
    clusters = op_tables.components(signature_trees._root_links(met, num, den))
    return clusters.groupBy("component").count().agg({"count": "max"}).first()[0]


def test_clusters_of_documents_stay_small(spark):
    """10,000 documents of very mixed lengths: what bitmaps leave together is little more than the true families."""
    docs = tables.documents(spark, "/root/testdata/sf0.1")
    assert largest_cluster(spark, docs, 5, 8, 10) < 100
