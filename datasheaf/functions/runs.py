"""Numbers at positions as packed runs of consecutive positions, on Arrow batches.

The bytes of a run's numbers lie in planes, so that small numbers make short or empty ones: the lowest two
bytes, the third, and the others, which are left out where they are zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from datasheaf.functions.arrow import given, listed, numbers

PLANES = ("__low", "__mid", "__high")
# Numbers that are put in order at a time; a group is never cut.
CELLS = 2**20
# Stands in a run for a number that comes by itself.
HOLE = 2**62


def _changes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Rows whose keys differ from those of the row before, the first row among them."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        code = batch[k].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= np.diff(code) != 0
    return new


def _bytes(values: np.ndarray, ends: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    offsets = pa.py_buffer((ends * values.itemsize).astype(np.int32))
    valid = None if mask is None else pa.py_buffer(np.packbits(mask, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [valid, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def packed_runs(keys: Sequence[str]):
    """Rows of `keys`, `pos`, `id` as a row for each run of consecutive positions with equal keys in a batch.

    A null id is a hole. A null position is a run by itself. `id` of the result is null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            pos, placed, known = numbers(b["pos"]), given(b["pos"]), given(b["id"])
            new = _changes(b, keys)
            new[1:] |= (np.diff(pos) != 1) | ~placed[1:] | ~placed[:-1]
            starts = np.flatnonzero(new)
            ends = np.append(starts, b.num_rows)
            ids = np.where(known, numbers(b["id"]), HOLE).astype(np.int64)
            high = np.where(known, ids >> 24, HOLE)
            # In a run with a hole or with large numbers all of `high` is given.
            some = np.logical_or.reduceat(high != 0, starts)
            kept = np.repeat(some, np.diff(ends))
            rows = pa.array(starts)
            at = np.append(0, np.cumsum(np.where(some, np.diff(ends), 0)))
            yield pa.RecordBatch.from_arrays(
                [*[b[k].take(rows) for k in keys], b["pos"].take(rows), pa.nulls(len(starts), pa.int64()),
                 _bytes((ids & 0xFFFF).astype("<u2"), ends), _bytes(((ids >> 16) & 0xFF).astype("u1"), ends),
                 _bytes(high[kept].astype("<i8"), at, some)],
                names=[*keys, "pos", "id", *PLANES])
    return run


def _plane(column: pa.Array, kind: str) -> np.ndarray:
    """All bytes of a binary column as numbers; nulls have none."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), kind).astype(np.int64)


def _in_order(batch: pa.RecordBatch, keys: Sequence[str], of_id: pa.DataType, least: int) -> pa.RecordBatch:
    """A row for each group of a batch of whole groups: its numbers by position."""
    new = _changes(batch, keys)
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    sizes = _lengths(batch)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    packed = [batch[c] for c in PLANES]
    run = given(packed[0])[row]
    pos, placed = numbers(batch["pos"])[row] + place, given(batch["pos"])[row]
    ids, known = numbers(batch["id"])[row], given(batch["id"])[row] | run
    high = np.zeros(len(row), np.int64)
    high[given(packed[2])[row]] = _plane(packed[2], "<i8")
    hole = high == HOLE
    low = np.zeros((2, len(row)), np.int64)
    low[:, run] = _plane(packed[0], "<u2"), _plane(packed[1], "u1")
    ids = np.where(run, low[0] + (low[1] << 16) + (np.where(hole, 0, high) << 24), ids)
    some = np.flatnonzero(~hole)
    some = some[np.lexsort((ids[some], known[some], pos[some], placed[some], group[row[some]]))]
    many = np.bincount(group[row[some]], minlength=len(first))
    values = pa.array(ids[some], pa.int64(), mask=~known[some]).cast(of_id)
    out = pa.RecordBatch.from_arrays([*[batch[k].take(pa.array(first)) for k in keys], listed(values, many)], names=[*keys, "ids"])
    return out.filter(pa.array(many >= least))


def _lengths(batch: pa.RecordBatch) -> np.ndarray:
    """Numbers that each row stands for."""
    return np.where(given(batch[PLANES[0]]), numbers(pc.binary_length(batch[PLANES[0]])) // 2, 1)


def joined_runs(keys: Sequence[str], of_id: pa.DataType, least: int):
    """Packed runs and single rows, sorted by `keys`, as a row for each group: `ids` by position, `least` of them at least."""
    def settled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(_changes(batch, keys))
        ends = np.append(first[1:], batch.num_rows)
        total = np.cumsum(_lengths(batch))[ends - 1]
        at = 0
        while at < len(first):
            before = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, before + CELLS, "right")))
            yield _in_order(batch.slice(first[at], ends[stop - 1] - first[at]), keys, of_id, least)
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            if held:  # the last group of a batch may go on
                both = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), b])
                starts = np.flatnonzero(_changes(both, keys))[1:] - 1
            else:
                starts = np.flatnonzero(_changes(b, keys))[1:]
            if len(starts):
                last = int(starts[-1])
                yield from settled(pa.concat_batches([*held, b.slice(0, last)]))
                held, b = [], b.slice(last)
            held.append(b)
        if held:
            yield from settled(pa.concat_batches(held))
    return run
