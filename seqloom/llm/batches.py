"""Cutting Arrow batches, so that a worker's memory follows neither the batch nor the text."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute


def slices(batches: Iterable[pa.RecordBatch], of: str, most: int = 8 << 20, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` rows whose column `of` has about `most` bytes."""
    for batch in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(of)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            to = min(to, at + rows)
            yield batch.slice(at, to - at)
            at = to


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string or binary column as bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def release() -> None:
    """Give memory that a task freed back to the machine: a worker is kept for later tasks, with all that it once held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
