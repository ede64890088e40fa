"""Array columns as flat Arrow values with the length of each row, for functions on whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lengths(lists: pa.Array) -> np.ndarray:
    """Elements of each list; a null list has none."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def listed(values: pa.Array, sizes: np.ndarray, like: pa.Array | None = None) -> pa.ListArray:
    """Lists of `sizes` consecutive values; null where `like` is null."""
    ends = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    mask = like.is_null() if like is not None and like.null_count else None
    return pa.ListArray.from_arrays(ends, values, mask=mask)


def numbers(values: pa.Array, missing: float = 0) -> np.ndarray:
    """Values with `missing` for nulls."""
    return pc.fill_null(values, missing).to_numpy(zero_copy_only=False) if values.null_count else values.to_numpy(zero_copy_only=False)


def given(values: pa.Array) -> np.ndarray:
    return values.is_valid().to_numpy(zero_copy_only=False)


def stretches(widths: np.ndarray, rows: int = 1024, cells: int = 2**18) -> Iterator[slice]:
    """Runs of rows that make a table of at most `cells` when padded to the widest one, a wider row alone."""
    at = widest = 0
    for i, w in enumerate(widths.tolist()):
        if i > at and (i - at == rows or max(widest, w) * (i + 1 - at) > cells):
            yield slice(at, i)
            at, widest = i, 0
        widest = max(widest, w)
    if len(widths):
        yield slice(at, len(widths))
