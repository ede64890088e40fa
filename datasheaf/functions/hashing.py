"""Reproducible random draws.

A draw is a function of (seed, id) only, so it does not depend on partitioning, retries or row
order, and any SQL engine with md5 computes the same value.
"""

from __future__ import annotations

try:
    from _md5 import md5  # half the time of hashlib's for texts this short
except ImportError:
    from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from datasheaf.functions.arrow import listed

_RANGE = 2**32


def digest(seed: int | str, *ids: Column | str) -> Column:
    """Hex md5 of `seed:id:id...`; its order is the shuffled order."""
    cols = [F.col(c) if isinstance(c, str) else c for c in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def draw_int(seed: int | str, *ids: Column | str) -> Column:
    """Integer in [0, 2**32)."""
    return F.conv(F.substring(digest(seed, *ids), 1, 8), 16, 10).cast("long")


def draw(seed: int | str, *ids: Column | str) -> Column:
    """Double in [0, 1)."""
    return draw_int(seed, *ids) / F.lit(float(_RANGE))


def _drawn(seed: str, n: pa.Array, ids: tuple[pa.Array, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Draws of the positions 0 to n - 1 of every row, one after the other, and how many each row has."""
    sizes = np.maximum(pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
    at = [b"%d" % i for i in range(int(sizes.max(initial=0)))]
    found = []
    columns = [i.to_pylist() for i in ids]
    for row, size in enumerate(sizes.tolist()):
        head = ":".join([seed, *[c[row] for c in columns if c[row] is not None], ""]).encode()
        found.append(b"".join([md5(head + i).digest() for i in at[:size]]))
    return np.frombuffer(b"".join(found), ">u4")[::4].astype(np.int64), sizes


def _texts(ids: tuple[Column | str, ...]) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).cast("string") for c in ids]


def draw_ints(seed: int | str, n: Column, *ids: Column | str) -> Column:
    """Array of `draw_int(seed, *ids, k)` for k = 0 to n - 1."""
    @F.arrow_udf("array<long>")
    def drawn(n: pa.Array, *ids: pa.Array) -> pa.Array:
        values, sizes = _drawn(str(seed), n, ids)
        return listed(pa.array(values), sizes, n)

    return drawn(n, *_texts(ids))


def draws(seed: int | str, n: Column, *ids: Column | str, low: float = 0.0, width: float = 1.0) -> Column:
    """Array of `draw(seed, *ids, k) * width + low` for k = 0 to n - 1."""
    @F.arrow_udf("array<double>")
    def drawn(n: pa.Array, *ids: pa.Array) -> pa.Array:
        values, sizes = _drawn(str(seed), n, ids)
        return listed(pa.array(values / float(_RANGE) * width + low), sizes, n)

    return drawn(n, *_texts(ids))
