"""Bounded memory in Python workers, which are reused by later stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def give_back() -> None:
    """Return freed memory to the system: what Arrow's pool and the C library keep for themselves."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`work` for `mapInArrow`; memory goes back after the last batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def slices(column: pa.Array, max_bytes: int) -> Iterator[pa.Array]:
    """Consecutive parts of a string or binary column of about `max_bytes` each; a longer value is a part of its own."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield column.slice(start, stop - start)
        start = stop
