"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of all texts are computed once and written; class moments (count,
sum, sum of outer products) are added up per partition and then over partitions,
so that fitting reads every labelled row and ships a few numbers.  Class
covariances shrink towards the pooled one and its diagonal; each is factored
once, and a score is the difference of two Gaussian log densities from those
Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.repetition import covered, longest_matches, per_text, repeated_lines
from parley.llm.words import slices, words_of
from parley.session import materialize

FEATURES = [
    "words", "word_length", "word_length_spread", "letters", "capitals", "digits", "symbols", "marks", "other_ascii", "beyond_ascii",
    "entropy", "lines", "line_repeats", "distinct_words", "repeated_runs", "covered_runs", "longest_run", "short_words", "long_words", "commonest_byte",
]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Shares on a log-odds scale, with half a count added to each side."""
    part, whole = part.astype(np.float64), whole.astype(np.float64)
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of :data:`FEATURES` per text; empty and null texts have defined values too."""
    words = words_of(texts)
    n = len(texts)
    sizes = np.diff(words.offsets)
    counts = np.zeros((n, 256), dtype=np.int64)
    for d in range(n):
        counts[d] = np.bincount(words.data[words.offsets[d] : words.offsets[d + 1]], minlength=256)
    kinds = lambda codes: counts[:, list(codes)].sum(axis=1)
    capitals, small, digits = kinds(range(65, 91)), kinds(range(97, 123)), kinds(range(48, 58))
    symbols, marks = kinds(b"#*$%&|<>"), kinds(b"!?.,;:")
    spaces, beyond = kinds([32, *range(9, 14)]), kinds(range(128, 256))
    with np.errstate(divide="ignore", invalid="ignore"):
        share = counts / np.maximum(sizes, 1)[:, None]
        entropy = -np.nansum(np.where(share > 0, share * np.log2(share), 0.0), axis=1)
    hashes = words.hashes()
    lengths = words.ends - words.starts
    n_words = np.diff(words.first)
    total, squares = per_text(lengths, words.first), per_text(lengths * lengths, words.first)
    mean = total / np.maximum(n_words, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(n_words, 1) - mean * mean, 0))
    matches = longest_matches(hashes, words.doc, least=2)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, words.doc, matches)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(words.first[:-1], words.first[1:])], dtype=np.int64)
    lines = counts[:, 10] + 1
    columns = [
        np.log1p(n_words), np.log1p(mean), np.log1p(spread), _share(capitals + small + beyond, sizes - spaces), _share(capitals, capitals + small),
        _share(digits, sizes - spaces), _share(symbols, sizes - spaces), _share(marks, sizes - spaces),
        _share(sizes - spaces - capitals - small - digits - symbols - marks - beyond, sizes - spaces), _share(beyond, sizes - spaces),
        entropy, np.log(lines / (n_words + 1)), _share(repeated_lines(words), lines), _share(distinct, n_words),
        _share(per_text(covered(matches, 3), words.first), n_words), _share(per_text(covered(matches, 8), words.first), n_words), np.log1p(longest),
        _share(per_text(lengths <= 3, words.first), n_words), _share(per_text(lengths > 12, words.first), n_words),
        _share(counts.max(axis=1) if n else np.zeros(0), sizes),
    ]
    return np.stack(columns, axis=1) if n else np.zeros((0, len(FEATURES)))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x = statistics(batch.column("text"))
        flat = pa.array(x.ravel())
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.ListArray.from_arrays(offsets, flat)], names=[*names, "x"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """``(doc_id, x)`` for every row of ``docs``, with the long ``key_col`` between them if there is one."""
    key = [F.col(key_col)] if key_col else []
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *key, F.col(text_col).alias("text"))
    return source.mapInArrow(_vectors, f"doc_id long, {_key_type(key_col)}x array<double>")


def _key_type(key_col: str | None) -> str:
    return f"`{key_col}` long, " if key_col else ""


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        x, y = _matrix(batch.column("x")), batch.column("label").to_numpy()
        for c in (0, 1):
            z = np.hstack([np.ones((int((y == c).sum()), 1)), x[y == c]])
            sums[c] = sums.get(c, 0) + z.T @ z
    for c, m in sums.items():
        size = m.shape[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size * size, c, dtype=np.int32)), pa.array(np.arange(size * size, dtype=np.int32)), pa.array(m.ravel())], names=["label", "at", "v"]
        )


@dataclass
class Discriminant:
    """Two Gaussians with their Cholesky factors; ``slope`` and ``offset`` turn log-density differences into log odds."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0."""
        density = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(-0.5 * ((z * z).sum(axis=0) + log_det))
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.clip(self.slope * self.difference(x) + self.offset, -500, 500)
        return 1.0 / (1.0 + np.exp(-odds))


def _discriminant(moments: np.ndarray, to_pooled: float, to_diagonal: float) -> Discriminant:
    """From the class moments ``[1 x]^T [1 x]``."""
    counts = moments[:, 0, 0]
    means = moments[:, 0, 1:] / counts[:, None]
    scatter = moments[:, 1:, 1:] - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / counts.sum()
    floor = 1e-3 * np.trace(pooled) / len(pooled) + 1e-9
    factors, log_dets = [], []
    for c in (0, 1):
        cov = (1 - to_pooled) * scatter[c] / counts[c] + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + floor * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        factors.append(factor)
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(factors), np.array(log_dets))


def _calibration(model: Discriminant):
    """Per partition: histogram of squashed log-density differences by label, bounded whatever the number of rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _BINS), dtype=np.int64)
        for batch in batches:
            d = model.difference(_matrix(batch.column("x")))
            at = np.clip(((np.arcsinh(d) + _REACH) / (2 * _REACH) * _BINS).astype(int), 0, _BINS - 1)
            np.add.at(counts, (batch.column("label").to_numpy(), at), 1)
        label, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[label, at].astype(np.float64))], names=["label", "at", "v"])

    return work


_BINS, _REACH = 800, 20.0


def _logistic(d: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through weighted counts (Newton steps with a small ridge)."""
    z = np.stack([d, np.ones_like(d)], axis=1)
    beta = np.array([0.1, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -500, 500)))
        grad = z.T @ (weight[1] - (weight[0] + weight[1]) * p) - 1e-3 * beta
        curve = (z * ((weight[0] + weight[1]) * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, grad)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 1e-6), float(beta[1])


def _added(df: DataFrame) -> dict[int, dict[int, float]]:
    """Sums by label and place: a few thousand numbers whatever the input."""
    out: dict[int, dict[int, float]] = {0: {}, 1: {}}
    for label, at, v in df.groupBy("label", "at").agg(F.sum("v").alias("v")).collect():
        out[label][at] = v
    return out


def fit(labelled: DataFrame, to_pooled: float = 0.3, to_diagonal: float = 0.1) -> Discriminant | float:
    """Model from all rows ``(x, label)`` with label 0 or 1; the share of label 1 (or 0.5) where a class has no rows."""
    size = len(FEATURES) + 1
    sums = _added(labelled.mapInArrow(_moments, "label int, at int, v double"))
    counts = [sums[c].get(0, 0.0) for c in (0, 1)]
    if not min(counts):
        return counts[1] / sum(counts) if sum(counts) else 0.5
    moments = np.array([[sums[c].get(i, 0.0) for i in range(size * size)] for c in (0, 1)]).reshape(2, size, size)
    model = _discriminant(moments, to_pooled, to_diagonal)
    bins = _added(labelled.mapInArrow(_calibration(model), "label int, at int, v double"))
    weight = np.array([[bins[c].get(i, 0.0) for i in range(_BINS)] for c in (0, 1)])
    model.slope, model.offset = _logistic(np.sinh((np.arange(_BINS) + 0.5) / _BINS * 2 * _REACH - _REACH), weight)
    return model


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def _score(model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            score = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            names = [c for c in batch.schema.names if c != "x"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(score)], names=[*names, "score"])

    return work


def quality_scores(
    docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row, and ``key_col``, a long, if there is one.

    ``labels(doc_id, quality)`` is learnt from rows whose CRC-32 of the id (as
    text) modulo ``folds`` is not ``fold``; ids without label, null labels and
    labels other than 0 and 1 teach nothing, and neither do rows without id, which
    count as held out.  An id with several labels teaches each of them.  Scores
    come from the text alone; empty and null texts have one too.  Without rows of
    both classes the score is the share of label 1, 0.5 without any.
    """
    vectors = materialize(document_statistics(docs, id_col, text_col, key_col), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)").distinct()
    labelled = vectors.where(~held_out("doc_id", folds, fold)).join(known, "doc_id").select("x", "label")
    model = fit(labelled)
    scored = vectors.mapInArrow(_score(model), f"doc_id long, {_key_type(key_col)}score double")
    key = [key_col] if key_col else []
    return scored.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *key)
