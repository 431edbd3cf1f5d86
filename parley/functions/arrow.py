"""Arrow batches in pieces small enough to become Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows that are Python objects at a time, whatever the size of Spark's batches.
SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, up to ``SLICE_ROWS`` at a time; columns are shared with the batch, not copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
