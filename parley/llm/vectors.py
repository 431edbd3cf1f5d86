"""Vectors of Arrow batches as numpy matrices, for use inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def rows_of_length(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and float64 matrix of the rows that are not null, have ``length`` entries and hold finite numbers only."""
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    present = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    rows = np.flatnonzero(present & (np.diff(offsets) == length))
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes NaN
    matrix = values[offsets[rows][:, None] + np.arange(length)] if length else np.zeros((len(rows), 0))
    finite = np.isfinite(matrix).all(axis=1)
    return rows[finite], matrix[finite]


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`rows_of_length` for every length that the column has."""
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    for length in np.unique(np.diff(offsets)).tolist():
        yield rows_of_length(column, length)


def floors(matrix: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as int64; raises where that does not fit."""
    scaled = np.floor(matrix * scale)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise ValueError("a vector entry is too large to become an integer of 64 bits")
    return scaled.astype(np.int64)


def exact_gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b`` of integer matrices, exact: in float64 while sums stay under 2**53, else in Python integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, len(a))
    if most < 1 << 53:
        return (a.T.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a.T @ b
    return a.T.astype(object) @ b.astype(object)
