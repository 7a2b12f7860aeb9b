"""Lists of different lengths in flat numpy arrays, and texts taken some megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
TEXT_BYTES = 8 << 20


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of flat that begin at starts and have these sizes, one after the other."""
    ends = np.cumsum(sizes)
    if not len(sizes) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]


def offsets(sizes: np.ndarray) -> np.ndarray:
    """Where lists of these sizes begin, and where the last one ends."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def slices(batch: pa.RecordBatch, column: int, most: int = TEXT_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many rows and bytes of a column of strings at most, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        end = min(max(at + 1, int(np.searchsorted(ends, before + most, "right"))), at + rows)
        yield batch.slice(at, end - at)
        at = end


def strings(array: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """An Arrow array without an offset into its buffers, and of one chunk."""
    return pa.concat_arrays(array.chunks if isinstance(array, pa.ChunkedArray) else [array])
