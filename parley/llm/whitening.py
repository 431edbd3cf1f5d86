"""Whitening of embeddings through the exact characteristic polynomial of their scatter.

1. *Scatter.*  Entries become integers; tasks sum them and their products exactly,
   so ``A = n * sum(x x') - S S'`` is an integer matrix and ``A / n**2`` the covariance.
2. *Polynomial.*  Tasks reduce ``A`` to Hessenberg form modulo primes of 31 bits, one
   row per prime, and read the characteristic polynomial off it.  Chinese remainders
   give the integer coefficients; as ``A`` has no negative eigenvalue, coefficient k is
   at most ``C(d, k) * (trace / d)**k``, which says how many primes are enough.
3. *Roots.*  The polynomial has real roots only, so the sign changes of its Taylor
   shift by ``a`` count the roots above ``a`` exactly.  One task per component bisects
   on that count in exact integers until its root stands alone, then on the sign.
4. *Components.*  The same task finds the null space of ``A - root`` by inverse
   iteration in 80 decimal digits.  Roots that agree to 2**-170 count as one multiple
   root, whose components are an orthonormal basis, the same in every task.

What passes through the driver is bounded by the number of dimensions d: d * d sums,
the coefficients modulo each prime, and d numbers per component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.vectors import exact_gram, floors, rows_of_length

SCALE, OFFSET = 64, 1_000_000
#: Components returned at most.
COMPONENTS = 32
#: Bits to which a root is known, beside the largest one.
ROOT_BITS = 170
DIGITS = 80

_LIMB = 30
_LIMBS = [f"l{k}" for k in range(7)]
_SUMS = "i int, j int, " + ", ".join(f"{c} long" for c in _LIMBS)


def _limbs(value: int) -> list[int]:
    """``value`` in signed digits of 30 bits, so that Spark can add exact numbers of any task in long columns."""
    out = []
    for _ in _LIMBS[:-1]:
        out.append(value & ((1 << _LIMB) - 1))
        value >>= _LIMB
    return [*out, value]


def _whole(row) -> int:
    return sum(int(row[c]) << (_LIMB * k) for k, c in enumerate(_LIMBS))


def _moments(length: int):
    """Sums (j = -1), products and the count (i = j = -1) of one task's vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, np.zeros(length, dtype=object), np.zeros((length, length), dtype=object)
        for batch in batches:
            _, matrix = rows_of_length(batch.column("v"), length)
            y = floors(matrix, SCALE)
            count += len(y)
            sums = sums + exact_gram(np.ones((len(y), 1), dtype=np.int64), y)[0].astype(object)
            products = products + exact_gram(y, y).astype(object)
        if count:
            rows = [(-1, -1, count), *((i, -1, int(sums[i])) for i in range(length))]
            rows += [(i, j, int(products[i, j])) for i in range(length) for j in range(i, length)]
            i, j, values = zip(*rows)
            limbs = zip(*map(_limbs, values))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(c, pa.int64()) for c in limbs)], names=["i", "j", *_LIMBS])

    return work


def scatter(vectors: DataFrame, length: int) -> tuple[int, list[int], list[list[int]]]:
    """Count n, sums of ``floor(64 * c)`` and the integer matrix ``n * sum(y y') - S S'``; the shift by ``OFFSET`` cancels in it."""
    parts = vectors.mapInArrow(_moments(length), _SUMS).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _LIMBS])
    n, sums, products = 0, [0] * length, {}
    for row in parts.collect():  # (d + 1) * (d + 2) / 2 rows at most
        if row["i"] < 0:
            n = _whole(row)
        elif row["j"] < 0:
            sums[row["i"]] = _whole(row)
        else:
            products[row["i"], row["j"]] = _whole(row)
    if not n:
        return 0, sums, []
    return n, sums, [[n * products[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(length)] for i in range(length)]


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all numbers under 3,215,031,751."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_over(bound: int) -> list[int]:
    """The largest primes of 31 bits, until their product is over ``bound``."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def modular_polynomial(matrix: list[list[int]], p: int) -> list[int]:
    """Characteristic polynomial modulo ``p``, constant term first, by reduction to Hessenberg form."""
    d = len(matrix)
    h = np.array([[x % p for x in row] for row in matrix], dtype=np.int64)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)
    polys[0, 0] = 1
    for m in range(d):
        grown = np.zeros(d + 1, dtype=np.int64)
        grown[1:] = polys[m, :-1]
        grown = (grown - h[m, m] * polys[m]) % p
        path = 1
        for i in range(m - 1, -1, -1):
            path = path * int(h[i + 1, i]) % p
            if not path:
                break
            grown = (grown - int(h[i, m]) * path % p * polys[i]) % p
        polys[m + 1] = grown
    return polys[d].tolist()


def _polynomials(matrix: list[list[int]]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            primes = batch.column("p").to_pylist()
            found = [modular_polynomial(matrix, p) for p in primes]
            yield pa.RecordBatch.from_arrays([pa.array(primes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["p", "c"])

    return work


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of the characteristic polynomial of a matrix without negative eigenvalues exceeds this."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    return max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))


def remainders_joined(residues: list[tuple[int, list[int]]]) -> list[int]:
    """The coefficients, of either sign, that leave the residues modulo each prime."""
    product = math.prod(p for p, _ in residues)
    total = [0] * len(residues[0][1])
    for p, c in residues:
        rest = product // p
        weight = rest * pow(rest % p, -1, p)
        total = [t + weight * x for t, x in zip(total, c)]
    total = [t % product for t in total]
    return [t - product if t > product // 2 else t for t in total]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients, constant term first; the primes are rows that Spark deals out."""
    primes = primes_over(2 * coefficient_bound(matrix))
    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(max(1, len(primes) // 16), "p")
    found = dealt.mapInArrow(_polynomials(matrix), "p long, c array<long>").collect()
    return remainders_joined([(r["p"], r["c"]) for r in found])


def roots_above(poly: list[int], t: int, bits: int) -> int:
    """How many roots, all real, are greater than ``t / 2**bits``: sign changes of the shifted polynomial."""
    d = len(poly) - 1
    c = [x << (bits * (d - k)) for k, x in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += t * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], t: int, bits: int) -> int:
    value, scale = 0, 1
    for x in reversed(poly):
        value = value * t + x * scale
        scale <<= bits
    return (value > 0) - (value < 0)


def isolate(poly: list[int], k: int) -> tuple[Fraction, int, int]:
    """The ``k``-th largest root (of positive ones), how many roots are greater, and its multiplicity."""
    top = max(1, -poly[-2]).bit_length()  # the sum of all roots bounds each of them
    low, high, bits = 0, 1 << top, 0
    above_low, above_high = roots_above(poly, 0, 0), 0
    last = ROOT_BITS
    while above_low - above_high > 1 and bits < last:
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        mid = (low + high) // 2
        count = roots_above(poly, mid, bits)
        if count >= k:
            low, above_low = mid, count
        else:
            high, above_high = mid, count
    if above_low - above_high == 1 and _sign(poly, high, bits):
        sign = _sign(poly, high, bits)
        while bits < last:
            if high - low == 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            mid = (low + high) // 2
            found = _sign(poly, mid, bits)
            if not found:
                low = high = mid
                break
            low, high = (low, mid) if found == sign else (mid, high)
    elif above_low - above_high == 1:
        low = high
    return Fraction(low + high, 2 << bits), above_high, above_low - above_high


def null_space(matrix: list[list[int]], root: Fraction, multiplicity: int) -> list[list[float]]:
    """Unit vectors that ``matrix`` multiplies by ``root``, orthogonal to one another, by inverse iteration."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        lu = np.array([[Decimal(x) - (shift if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)], dtype=object)
        tiny = max(abs(x) for x in lu.ravel()) * Decimal(10) ** (10 - DIGITS) or Decimal(10) ** -DIGITS
        order = list(range(d))
        for m in range(d):
            pivot = max(range(m, d), key=lambda i: abs(lu[i, m]))
            if pivot != m:
                lu[[m, pivot]] = lu[[pivot, m]]
                order[m], order[pivot] = order[pivot], order[m]
            if abs(lu[m, m]) < tiny:
                lu[m, m] = tiny
            if m + 1 < d:
                lu[m + 1 :, m] = lu[m + 1 :, m] / lu[m, m]
                lu[m + 1 :, m + 1 :] = lu[m + 1 :, m + 1 :] - np.outer(lu[m + 1 :, m], lu[m, m + 1 :])
        basis = [np.array([Decimal(1 + (i * (2 * r + 3) + r * r + i * i * (r + 1)) % 101) for i in range(d)], dtype=object) for r in range(multiplicity)]
        for _ in range(3):
            solved: list[np.ndarray] = []
            for v in basis:
                x = v[order]
                for i in range(1, d):
                    x[i] -= lu[i, :i] @ x[:i]
                for i in range(d - 1, -1, -1):
                    x[i] = (x[i] - (lu[i, i + 1 :] @ x[i + 1 :] if i + 1 < d else 0)) / lu[i, i]
                for _ in range(2):
                    x = x / max(abs(e) for e in x)
                    for u in solved:
                        x = x - (u @ x) * u
                solved.append(x / (x @ x).sqrt())
            basis = solved
        return [[float(e) for e in v] for v in basis]


def _components(matrix: list[list[int]], poly: list[int]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("k").to_pylist():
                root, greater, multiplicity = isolate(poly, k)
                vector = null_space(matrix, root, multiplicity)[k - greater - 1]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([f"{root.numerator}/{root.denominator}"]), pa.array([vector], pa.list_(pa.float64()))], names=["k", "root", "vector"])

    return work


def principal_components(spark, matrix: list[list[int]], most: int = COMPONENTS) -> list[tuple[Fraction, list[float]]]:
    """Roots and unit vectors by falling root, positive roots only, ``most`` at most."""
    if not matrix:
        return []
    poly = characteristic_polynomial(spark, matrix)
    count = min(most, roots_above(poly, 0, 0))
    if not count:
        return []
    dealt = spark.createDataFrame([(k + 1,) for k in range(count)], "k int").repartition(count, "k")
    found = dealt.mapInArrow(_components(matrix, poly), "k int, root string, vector array<double>").collect()
    return [(Fraction(r["root"]), r["vector"]) for r in sorted(found, key=lambda r: r["k"])]


def _whitened(y: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (y - mean) @ axes


def _products(length: int, mean: np.ndarray, axes: np.ndarray):
    """Sums of whitened values and of their products in one task."""
    k = axes.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = _whitened(floors(rows_of_length(batch.column("v"), length)[1], SCALE), mean, axes)
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "s"])

    return work


def _projected(length: int, n: int, sums: list[int], mean: np.ndarray, axes: np.ndarray):
    wrapped = np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums], dtype=np.int64)
    exact = np.array(sums, dtype=np.float64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, matrix = rows_of_length(batch.column("v"), length)
            y = floors(matrix, SCALE)
            apart = y * np.int64(n) - wrapped  # modulo 2**64, which is exact wherever the sum of squares fits
            deviation = (apart * apart).sum(axis=1)
            fits = ((y * float(n) - exact) ** 2).sum(axis=1) < 2.0**63
            w = _whitened(y, mean, axes)
            values = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], w.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(deviation, mask=~fits), values], names=["id", "deviation", "w"])

    return work


def common_length(vectors: DataFrame) -> int | None:
    """The length that most clean vectors have, the greater one of equals."""
    clean = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sizes = vectors.where(F.col("v").isNotNull()).where(clean).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    first = sizes.where("d > 0").orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    return first[0]["d"] if first else None


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row per clean vector and component.

    An entry c is the integer ``x = floor(64 * c) + 1000000``; one that does not fit
    62 bits is an error.  Vectors that are null, hold null or non-finite entries, or
    have another length than most clean ones have no row and no part in the fit.  All
    other rows count as they are, repeated ones and those without id too.
    Components have a positive variance, so there are none for equal vectors or an
    empty table (no rows then), and fewer than ``components`` where the scatter has a
    lower rank.  ``deviation`` is null where it does not fit a long.  The order of
    components of one multiple eigenvalue is arbitrary and the same for all rows.
    Columns other than id and vector are not read.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    length = common_length(vectors)
    n, sums, matrix = scatter(vectors, length) if length else (0, [], [])
    found = principal_components(spark, matrix, components)
    id_type = vectors.schema["id"].dataType
    if not found:
        return spark.createDataFrame([], "component int, n long, deviation long, whitened double, explained double, identity_error double").select(
            F.lit(None).cast(id_type).alias("vec_id"), "*"
        )
    trace = sum(matrix[i][i] for i in range(length))
    mean = np.array([float(Fraction(s, n)) for s in sums])
    axes = np.array([vector for _, vector in found]).T / np.array([math.sqrt(Fraction(root, n * n)) for root, _ in found])
    error = _identity_error(vectors, length, n, mean, axes)
    rows = vectors.mapInArrow(_projected(length, n, sums, mean, axes), f"id {id_type.simpleString()}, deviation long, w array<double>")
    explained = F.array(*[F.lit(float(Fraction(root, trace))) for root, _ in found])
    return rows.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _identity_error(vectors: DataFrame, length: int, n: int, mean: np.ndarray, axes: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened values minus the identity, over all rows."""
    k = axes.shape[1]
    total = np.zeros((k + 1, k))
    for r in vectors.mapInArrow(_products(length, mean, axes), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] = r["s"]
    off = total[k] / n
    return float(np.abs(total[:k] / n - np.outer(off, off) - np.eye(k)).max())
