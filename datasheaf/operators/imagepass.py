"""Detections of whole images matched in one pass over their boxes, for images of few boxes.

The boxes of an image come together sorted, predictions and ground truth in one table. Overlaps live only in
the memory of the task that reads the image, and a detection leaves as one row, whose bits stand for the
ancestors of its class. So what travels is a row for each box, none for an overlap or an ancestor.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa

# What a row is: of a detection, whether its area is in range; of ground truth, what it is good for.
IN_RANGE, TRUTH, CROWD, SERVES, UNSIZED = 1, 2, 4, 8, 16
# What a row of the result is: a detection of a class, one of a single category, an image left to others.
OF_CLASS, OF_CATEGORY, LEFT = 0, 1, 2
# Pairs of boxes that a task compares at a time; an image is never cut.
PAIRS = 2**19
# Ordered rows that are cut into stretches at a time.
STRETCH = 100_000


class Lineage:
    """Categories that a class counts for, by codes. A class that is not listed counts for itself, null for nothing."""

    def __init__(self, listed: dict[Hashable, Sequence[Hashable]]):
        self.listed, self.code, self.values = listed, {}, []
        self.up: dict[int, np.ndarray] = {}
        self.both: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _code(self, value: Hashable) -> int:
        if value not in self.code:
            self.code[value] = len(self.values)
            self.values.append(value)
        return self.code[value]

    def codes(self, column: pa.Array) -> np.ndarray:
        """The code of each class, -1 for null."""
        d = column.dictionary_encode()
        known = np.array([*map(self._code, d.dictionary.to_pylist()), -1], np.int64)
        return known[d.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)]

    def above(self, code: int) -> np.ndarray:
        if code not in self.up:
            found = self.listed.get(self.values[code], [self.values[code]]) if code >= 0 else []
            self.up[code] = np.array([self._code(x) for x in found], np.int64)
        return self.up[code]

    def shared(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Categories that both classes count for, and their places among those of `a`."""
        if (a, b) not in self.both:
            at = np.flatnonzero(np.isin(self.above(a), self.above(b)))
            self.both[a, b] = self.above(a)[at], at
        return self.both[a, b]

    def expanded(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each pair of classes once for each category they share: the pair's number, the category, its place."""
        width = int(max(a.max(initial=0), b.max(initial=0))) + 2
        kinds, kind = np.unique((a + 1) * width + b + 1, return_inverse=True)
        return _listed([self.shared(int(k // width) - 1, int(k % width) - 1) for k in kinds], kind)

    def each(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each class once for each category it counts for, as `expanded`."""
        kinds, kind = np.unique(a, return_inverse=True)
        lists = [self.above(int(k)) for k in kinds]
        return _listed([(x, np.arange(len(x))) for x in lists], kind)


def _runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes one after the other: the run of each element, and its place in the run."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _listed(lists: list[tuple[np.ndarray, np.ndarray]], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x, _ in lists], np.int64)
    row, place = _runs(sizes[kind])
    if not len(row):
        return row, row, row
    at = (np.cumsum(sizes) - sizes)[kind][row] + place
    return row, *(np.concatenate([x[i] for x in lists])[at] for i in (0, 1))


def _above(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    """a > b where NaN is larger than any number, as in Spark."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _at_least(a: np.ndarray, b: float) -> np.ndarray:
    return (a >= b) | np.isnan(a)


class _Boxes:
    """Columns of a batch of whole images as arrays."""

    def __init__(self, batch: pa.RecordBatch, classes: Lineage):
        def numbers(c: str) -> np.ndarray:
            return batch[c].to_numpy(zero_copy_only=False).astype(float)

        self.image = batch["image_id"].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        self.kind = batch["kind"].to_numpy(zero_copy_only=False)
        self.truth = self.kind & TRUTH != 0
        self.known = batch["id"].is_valid().to_numpy(zero_copy_only=False)
        self.id = batch["id"].fill_null(0).to_numpy(zero_copy_only=False)
        self.cls = classes.codes(batch["category_id"])
        self.scored = batch["score"].is_valid().to_numpy(zero_copy_only=False)
        self.score = numbers("score")
        self.x0, self.y0, self.x1, self.y1 = (numbers(c) for c in ("x0", "y0", "x1", "y1"))
        sized = np.all([batch[c].is_valid().to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")], axis=0)
        solid = sized & _above(self.x1, self.x0) & _above(self.y1, self.y0)
        self.meets = solid & (self.cls >= 0) & batch["image_id"].is_valid().to_numpy(zero_copy_only=False)
        self.size = (self.x1 - self.x0) * (self.y1 - self.y0)

    def odd_images(self) -> np.ndarray:
        """Rows of images in which an id is null, or comes twice on one side."""
        order = np.lexsort((self.id, self.truth, self.image))
        twice = np.all([np.diff(x[order]) == 0 for x in (self.image, self.id, self.truth.astype(int))], axis=0)
        return np.isin(self.image, np.append(self.image[order][1:][twice], self.image[~self.known]))

    def pairs(self, dets: np.ndarray, truth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Overlaps of boxes of one image, a few images at a time: both rows and the share."""
        images = int(self.image.max(initial=-1)) + 1
        first = np.searchsorted(self.image[truth], np.arange(images))
        many = np.bincount(self.image[truth], minlength=images)
        ends = np.cumsum(np.bincount(self.image[dets], minlength=images) * many)
        cut, at = 0, 0
        while at < images:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            upto = int(np.searchsorted(self.image[dets], stop))
            some = dets[cut:upto]
            a, place = _runs(many[self.image[some]])
            a = some[a]
            b = truth[first[self.image[a]] + place]
            yield self._overlaps(a, b)
            cut, at = upto, stop

    def _overlaps(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def side(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return np.maximum(np.fmin(hi[a], hi[b]) - np.maximum(lo[a], lo[b]), 0.0)

        both = side(self.x0, self.x1) * side(self.y0, self.y1)
        met = _above(both, 0.0)
        a, b, both = a[met], b[met], both[met]
        union = np.where(self.kind[b] & CROWD != 0, self.size[a], self.size[a] + self.size[b] - both)
        share = np.divide(both, union, out=np.zeros(len(both)), where=_above(union, 0.0))
        return a, b, share


def _matched(x: _Boxes, classes: Lineage, a: np.ndarray, b: np.ndarray, share: np.ndarray, hits: np.ndarray, ignored: np.ndarray) -> None:
    """Greedy matching in each category; sets the bits of what is hit and what is ignored."""
    pair, category, place = classes.expanded(x.cls[a], x.cls[b])
    if not len(pair):
        return
    a, b, share, bit = a[pair], b[pair], share[pair], np.int64(1) << place
    width = int(category.max()) + 1
    left, right = a * width + category, b * width + category
    alone = np.ones(len(left), bool)
    for node in (left, right):
        _, at, n = np.unique(node, return_inverse=True, return_counts=True)
        alone &= n[at] == 1
    serves, unsized = (x.kind[b] & k != 0 for k in (SERVES, UNSIZED))
    chosen = alone.copy()
    rest = np.flatnonzero(~alone)
    # Best detection first, its ground truth without an area first, then one that counts; larger overlap, later id.
    r, g = a[rest], b[rest]
    order = rest[np.lexsort((-x.id[g], -share[rest], np.where(unsized[rest], 0, np.where(serves[rest], 1, 2)), x.id[r], -x.score[r], x.scored[r]))]
    used, held = set(), set()
    crowd = x.kind[b[order]] & CROWD != 0
    for i, one, other, any_number in zip(order.tolist(), left[order].tolist(), right[order].tolist(), crowd.tolist(), strict=True):
        if one in used or (not any_number and other in held):
            continue
        used.add(one)
        held.add(other)
        chosen[i] = True
    hit = chosen & serves
    passed = chosen & ~serves & (alone | ~unsized)
    np.bitwise_or.at(hits, a[hit], bit[hit])
    np.bitwise_or.at(ignored, a[passed], bit[passed])


def _best(order: Sequence[np.ndarray], group: np.ndarray) -> np.ndarray:
    """The first element of each group by `order`, the last key first."""
    at = np.lexsort((*order, group))
    return at[np.append(True, np.diff(group[at]) != 0)] if len(at) else at


def _found_groups(x: _Boxes, classes: Lineage, a: np.ndarray, b: np.ndarray, share: np.ndarray, hits: np.ndarray, counted: np.ndarray) -> None:
    """Of the idle detections in a group's box, each in that of its largest share, the best one is a hit."""
    pair, category, place = classes.expanded(x.cls[a], x.cls[b])
    bit = np.int64(1) << place
    idle = np.flatnonzero((hits[a[pair]] | counted[a[pair]]) & bit == 0)
    if not len(idle):
        return
    pair, category, bit = pair[idle], category[idle], bit[idle]
    a, b, share = a[pair], b[pair], share[pair]
    width = int(category.max()) + 1
    own = _best((x.id[b], -share), a * width + category)
    a, b, category, bit = a[own], b[own], category[own], bit[own]
    first = _best((x.id[a], -x.score[a], x.scored[a]), b * width + category)
    for bits in (hits, counted):
        np.bitwise_or.at(bits, a[first], bit[first])


def _settled(batch: pa.RecordBatch, classes: Lineage, iou: float, groups_count: bool, names: Sequence[str]) -> pa.RecordBatch:
    with np.errstate(all="ignore"):
        x = _Boxes(batch, classes)
        odd = x.odd_images()
        dets = np.flatnonzero(~x.truth & ~odd)
        hits, ignored = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        full = np.zeros(batch.num_rows, np.int64)
        kinds, kind = np.unique(x.cls[dets], return_inverse=True)
        full[dets] = np.array([(1 << len(classes.above(int(k)))) - 1 for k in kinds], np.int64)[kind] if len(dets) else 0
        counted = np.where(x.kind & IN_RANGE != 0, full, 0)
        for a, b, share in x.pairs(dets[x.meets[dets]], np.flatnonzero(x.truth & x.meets & ~odd)):
            near = _at_least(share, min(iou, 1 - 1e-10))
            _matched(x, classes, a[near], b[near], share[near], hits, ignored)
            some = np.unique(a)
            counted[some] = (counted[some] | hits[some]) & ~ignored[some]
            if groups_count:
                inside = _at_least(share, iou) & (x.kind[b] & CROWD != 0)
                _found_groups(x, classes, a[inside], b[inside], share[inside], hits, counted)
    dets = dets[(hits[dets] | counted[dets]) != 0]
    left = np.flatnonzero(odd)
    left = left[np.append(True, np.diff(x.image[left]) != 0)] if len(left) else left
    rows = pa.array(np.append(dets, left))
    nothing = np.zeros(len(left), np.int64)
    kind = np.append(np.full(len(dets), OF_CLASS, np.int32), np.full(len(left), LEFT, np.int32))
    return pa.RecordBatch.from_arrays(
        [*[batch[c].take(rows) for c in ("image_id", "category_id", "id", "score")],
         *[pa.array(np.append(v[dets], nothing)) for v in (counted, hits)], pa.array(kind)], names=names)


def image_matches(listed: dict[Hashable, Sequence[Hashable]], iou: float, groups_count: bool, names: Sequence[str]):
    """A function of batches of boxes sorted by image: a row for each detection that is a hit or counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, held = Lineage(listed), None
        for b in batches:
            if not b.num_rows:
                continue
            b = b if held is None else pa.concat_batches([held, b])
            image = b["image_id"].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(np.append(True, np.diff(image) != 0))[-1])  # its image may go on
            held = b.slice(last)
            if last:
                yield _settled(b.slice(0, last), classes, iou, groups_count, names)
        if held is not None:
            yield _settled(held, classes, iou, groups_count, names)
    return run


def class_stretches(listed: dict[Hashable, Sequence[Hashable]], of_category: pa.DataType, names: Sequence[str]):
    """Ordered rows of classes as a row for each category and run of STRETCH rows, in the layout of the curve."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, held, rows, no = Lineage(listed), [], 0, 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= STRETCH:
                out = _cut(held, classes, no, of_category, names)
                held, rows, no = [], 0, no + out.num_rows
                yield out
        if rows:
            yield _cut(held, classes, no, of_category, names)
    return run


def _cut(batches: list[pa.RecordBatch], classes: Lineage, no: int, of_category: pa.DataType, names: Sequence[str]) -> pa.RecordBatch:
    b = pa.concat_batches(batches)
    cls, single = classes.codes(b["category_id"]), b["kind"].to_numpy(zero_copy_only=False) == OF_CATEGORY
    own, many = np.flatnonzero(single & (cls >= 0)), np.flatnonzero(~single)
    row, category, place = classes.each(cls[many])
    row, category, place = np.append(many[row], own), np.append(category, cls[own]), np.append(place, np.zeros(len(own), np.int64))
    hits, counted = ((b[c].to_numpy(zero_copy_only=False)[row] >> place) & 1 for c in ("hits", "counted"))
    some = np.flatnonzero(hits | counted)
    some = some[np.lexsort((row[some], category[some]))]
    hits, counted, category = hits[some], counted[some], category[some]
    starts = np.flatnonzero(np.append(True, np.diff(category) != 0)) if len(some) else some
    ends = pa.array(np.append(starts, len(some)), pa.int32())
    unit = pa.array(np.arange(len(starts) + 1), pa.int32())
    sums = [np.add.reduceat(v, starts) if len(some) else v for v in (hits, counted)]
    return pa.RecordBatch.from_arrays(
        [pa.array([classes.values[c] for c in category[starts].tolist()], of_category),
         pa.array(np.full(len(starts), b["__range"][0].as_py()), pa.int32()), pa.array(np.arange(no, no + len(starts)), pa.int64()),
         *[pa.ListArray.from_arrays(unit, pa.array(v, pa.int64())) for v in sums],
         *[pa.ListArray.from_arrays(ends, pa.array(v, pa.int64())) for v in (hits, counted)]], names=names)
