"""Whitening, near-duplicate vectors and sharded Lloyd against brute force."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import rotated_codes, sharded_lloyd, whitening
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASHES = ["id", "v", "row", "block", "x", "far", "t", "key", "node", "d", "ball", "n", "at", "w", "component", "cluster"]


def vectors(spark):
    return spark.read.parquet(f"{SMALL}/embeddings.parquet")


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df


def point(seed, length=64):
    return np.random.default_rng(seed).normal(size=length).astype(np.float32)


def awkward(length=64):
    """Nulls, zero, empty, other lengths, repeated rows and ids, and copies of other lengths and signs."""
    a, b = point(1, length), point(2, length)
    broken = a.tolist()
    broken[3] = None
    nan, inf = a.tolist(), a.tolist()
    nan[0], inf[-1] = math.nan, -math.inf
    return [
        (1, a.tolist(), 0), (2, a.tolist(), 1), (2, a.tolist(), 1), (3, (a * 2).tolist(), None), (4, (-a).tolist(), 0), (5, None, 0), (6, broken, 0), (7, nan, 0),
        (8, inf, 0), (9, [0.0] * length, 0), (10, [], 0), (11, [1.0], 0), (12, [1.0], 0), (13, a.tolist()[:-1], 0), (None, b.tolist(), None), (None, b.tolist(), None),
        (None, point(3, length).tolist(), 0), (None, None, None), (-5, b.tolist(), 0), (20, point(4, length).tolist(), 0), (20, point(5, length).tolist(), 0),
    ]


def usable(rows, length):
    return [(i, np.array(v, dtype=float)) for i, v, _ in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]


def family(n, spread, first, seed, length=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=length)
    return [(first + i, (base + spread * rng.normal(size=length)).astype(np.float32).tolist(), 0) for i in range(n)]


# --- whitening ---


def whitened_by_eigh(rows, most=32):
    x = np.array([np.floor(64 * v) + 1_000_000 for _, v in rows])
    n = len(x)
    centred = x - x.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    deviation = [sum(int(z) ** 2 for z in r) for r in (n * x - x.sum(axis=0)).astype(int)]
    return centred @ u / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(centred.T @ centred / n), deviation


def check_whitened(got, rows, components):
    want, explained, deviation = whitened_by_eigh(rows, components)
    assert len(got) == len(rows) * components and {r["n"] for r in got} == {len(rows)}
    assert max(abs(r["explained"] / explained[r["component"] - 1] - 1) for r in got) < 1e-9
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    for c in range(1, components + 1):
        mine = sorted((str(r["vec_id"]), r["deviation"], round(r["whitened"], 6)) for r in got if r["component"] == c)
        close = False
        for sign in (1, -1):
            plain = sorted((str(i), deviation[k], round(sign * want[k, c - 1], 6)) for k, (i, _) in enumerate(rows))
            assert [m[:2] for m in mine] == [p[:2] for p in plain]
            close |= max(abs(m[2] - p[2]) for m, p in zip(mine, plain)) < 1e-5
        assert close


def test_whitening_of_vectors(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in vectors(spark).collect()]
    check_whitened(whitening.whiten(vectors(spark)).collect(), rows, 32)


def test_whitening_of_awkward_rows(spark):
    rows = awkward(6) + [(100 + k, point(50 + k, 6).tolist(), 0) for k in range(30)]
    check_whitened(whitening.whiten(frame(spark, rows)).collect(), usable(rows, 6), 6)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(k, [1.0, 2.0], 0) for k in range(3)]])
def test_whitening_of_nothing_that_varies(spark, rows):
    got = whitening.whiten(frame(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.collect() == []


def test_whitening_has_as_many_components_as_the_rank(spark):
    rows = [(k, [float(k), 2.0 * k, 5.0], 0) for k in range(9)]
    assert {r["component"] for r in whitening.whiten(frame(spark, rows)).collect()} == {1}


def test_characteristic_polynomial_is_exact(spark):
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 9):
        b = rng.integers(-(10**6), 10**6, (d, d)).tolist()
        matrix = [[sum(b[k][i] * b[k][j] for k in range(d)) for j in range(d)] for i in range(d)]
        power, want, c = [[int(i == j) for j in range(d)] for i in range(d)], [1], 1  # Faddeev-LeVerrier
        for k in range(1, d + 1):
            power = [[sum(matrix[i][m] * power[m][j] for m in range(d)) for j in range(d)] for i in range(d)]
            c = -sum(power[i][i] for i in range(d)) // k
            want.append(c)
            power = [[power[i][j] + (c if i == j else 0) for j in range(d)] for i in range(d)]
        assert whitening.characteristic_polynomial(spark, matrix) == want[::-1]


def test_roots_are_isolated_with_their_multiplicity():
    poly = [1]
    for root in (0, 3, 3, 7, 10**12, 10**12 + 1):
        poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0])]
    found = [whitening.isolate(poly, k) for k in range(1, whitening.roots_above(poly, 0, 0) + 1)]
    assert [m for _, _, m in found] == [1, 1, 1, 2, 2]
    for (root, _, _), want in zip(found, (10**12 + 1, 10**12, 7, 3, 3)):
        assert abs(root - want) < Fraction(1, 1 << 160)


def test_components_of_close_and_multiple_roots():
    """Roots 10**12 and 10**12 + 1 have their own axes, a double root an orthonormal basis."""
    axes = [[1, 1, 0, 0], [1, -1, 0, 0], [0, 0, 1, 1], [0, 0, 1, -1]]
    roots = [2 * 10**12, 2 * 10**12 + 2, 6, 6]
    matrix = [[sum(r * a[i] * a[j] for r, a in zip(roots, axes)) // 2 for j in range(4)] for i in range(4)]
    first = whitening.null_space(matrix, Fraction(roots[0]), 1)[0]
    assert np.abs(np.abs(first) - np.array([0.5, 0.5, 0, 0]) ** 0.5).max() < 1e-15 and first[0] * first[1] > 0
    basis = np.array(whitening.null_space(matrix, Fraction(6), 2))
    assert np.abs(basis @ basis.T - np.eye(2)).max() < 1e-15 and np.abs(basis[:, :2]).max() < 1e-15


# --- near-duplicate vectors ---


def linked(rows, threshold):
    """(id, links, component, kept) of all rows by comparing all pairs."""
    n = len(rows)
    last = rotated_codes.NO_ID
    ids = [last if i is None else i for i, _, _ in rows]
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    unit = [np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if g else None for (_, v, _), g in zip(rows, good)]
    root, degree = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                degree[i] += 1
                degree[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(n):
        least[find(i)] = min(ids[i], least.get(find(i), last))
    real = lambda i: None if i == last else i
    return sorted(((real(ids[i]), degree[i], real(least[find(i)]), ids[i] == least[find(i)]) for i in range(n)), key=repr)


def links_found(df):
    return sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in df.collect()), key=repr)


def test_links_between_awkward_vectors(spark):
    rows = awkward() + family(12, 0.1, 200, 7)
    assert links_found(rotated_codes.near_duplicate_vectors(frame(spark, rows), 0.951)) == linked(rows, 0.951)
    assert links_found(rotated_codes.near_duplicate_vectors(frame(spark, []))) == []


@pytest.mark.parametrize("bucket, block, full", [(192, 2048, 256), (40, 16, 12), (10, 8, 10**9)])
def test_links_in_families_around_the_threshold(spark, bucket, block, full):
    """Tight families, which become balls, loose ones at the threshold, and neighbours of a ball."""
    rows = family(90, 0.06, 1000, 1) + family(40, 0.06, 500, 2) + family(60, 0.2, 2000, 3) + family(5, 0.25, 1000, 1)
    rows += [(3000 + i, point(100 + i).tolist(), 0) for i in range(80)] + [(4000 + i, rows[i][1], 0) for i in range(20)]
    rows = [(4999 if k == 0 else i, v, l) for k, (i, v, l) in enumerate(rows)]
    want = linked(rows, 0.95)
    got = links_found(rotated_codes.near_duplicate_vectors(frame(spark, rows), bucket=bucket, block=block, full=full))
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.99 * there <= found <= there
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((r[0], r[2], r[3]) for r in want)
    ours, theirs = ({i: sum(r[1] for r in all_ if r[0] == i) for i, *_ in all_} for all_ in (got, want))
    assert all(ours[i] <= theirs[i] for i in theirs)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    z = rng.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(axis=1)[:, None] * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1)[:, None]
    codes, factors = rotated_codes.encode(x)
    found = np.array([rotated_codes.estimates(codes[i : i + 1], factors[i : i + 1], y[i : i + 1])[0, 0] for i in range(len(x))])
    assert abs(found.mean() - 0.95) < 0.002
    assert (found >= rotated_codes.least_estimate(factors, 64, 0.95)).all()


def test_spanning_labels():
    a, b = np.array([5, 4, 3, 8]), np.array([4, 3, 2, 9])
    assert rotated_codes.spanning(a, b, 10).tolist() == [0, 1, 2, 2, 2, 2, 6, 7, 8, 8]


# --- sharded Lloyd ---


def lloyd(rows, clusters, rounds, length):
    rows = usable(rows, length)
    x = [[math.floor(256 * e) for e in v.tolist()] for _, v in rows]
    order = sorted(range(len(x)), key=lambda k: (hashlib.sha256(f"2:{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest(), rows[k][1].tolist()))
    centroids = [x[k] for k in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        label = [nearest(v)[1] for v in x]
        for k in range(len(centroids)):
            mine = [v for v, c in zip(x, label) if c == k]
            if mine:
                centroids[k] = [sum(column) // len(mine) for column in zip(*mine)]
    label = [nearest(v) for v in x]
    inertia = {k: sum(d for d, c in label if c == k) for k in range(len(centroids))}
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), text[c]) for (i, _), (d, c) in zip(rows, label)), key=repr)


def clustered(df):
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def test_clusters_of_vectors(spark):
    rows = [tuple(r) for r in vectors(spark).select("vec_id", "embedding", "label").collect()]
    assert clustered(sharded_lloyd.cluster(vectors(spark))) == lloyd(rows, 40, 5, 64)


@pytest.mark.parametrize("block", [1, 4, 32])
def test_clusters_of_awkward_rows(spark, block):
    """Other block widths, fewer rows than clusters, ties between equal centroids, large entries."""
    rows = awkward(6)
    rows += [(60, [1e6, -1e6, 3.5, 0.0, 1.0, -0.001], 0), (61, [9e5, -1e6, 3.5, 0.0, 1.0, -0.001], 0)]
    assert clustered(sharded_lloyd.cluster(frame(spark, rows), 4, 3, 6, block=block)) == lloyd(rows, 4, 3, 6)
    assert clustered(sharded_lloyd.cluster(frame(spark, rows), 40, 1, 6, block=block)) == lloyd(rows, 40, 1, 6)


def test_clusters_of_nothing(spark):
    got = sharded_lloyd.cluster(frame(spark, [(1, None, 0)]))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.collect() == []


def test_packed_rows_keep_their_values():
    for most in (100, 10**6, 10**14):
        matrix = np.random.default_rng(2).integers(-most, most, (50, 7))
        assert (sharded_lloyd.unpack(sharded_lloyd.pack(matrix), 7) == matrix).all()
