"""Parts of Arrow batches, so that a task's memory does not follow the size of the batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SLICE_ROWS = 2_000


def slices(texts: pa.Array, *others: pa.Array, step: int = 1) -> Iterator[tuple[pa.Array, ...]]:
    """The arrays in parts that hold about `SLICE_BYTES` of text each; every row is whole.

    A part holds a multiple of `step` texts that are not NULL, except the last one, so that
    requests of `step` texts are as full as they are over the whole batch.
    """
    n = len(texts)
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), out=ends[1:])
    there = np.zeros(n + 1, np.int64)
    np.cumsum(texts.is_valid().to_numpy(zero_copy_only=False), out=there[1:])
    start = 0
    while start < n:
        end = int(np.searchsorted(ends, ends[start] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, start + 1), start + SLICE_ROWS, n)
        wanted = -(-(there[end] - there[start]) // step) * step
        end = max(end, min(int(np.searchsorted(there, there[start] + wanted)), n))
        yield tuple(column.slice(start, end - start) for column in (texts, *others))
        start = end
