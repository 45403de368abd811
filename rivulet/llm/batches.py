"""Arrow batches of bounded text, so that long texts in one batch do not add up in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
MOST = 8 << 20


def bounded(batches: Iterator[pa.RecordBatch], most: int = MOST) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose last column, a text, has at most so many bytes together, or that are a single row."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield b.slice(at, end - at)
            at = end
