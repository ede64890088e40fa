"""Box and keypoint arithmetic on four double columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return x, y, x + w, y + h


def xyxy_to_xywh(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, ...]:
    return x0, y0, x1 - x0, y1 - y0


def yxyx_to_xyxy(y0: Column, x0: Column, y1: Column, x1: Column) -> tuple[Column, ...]:
    return x0, y0, x1, y1


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 - x0) * (y1 - y0)


def intersection(a: str, b: str) -> Column:
    """Overlap of struct columns `a` and `b` with fields x0, y0, x1, y1."""
    def side(lo: str, hi: str) -> Column:
        gap = F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(
            F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")
        )
        return F.greatest(gap, F.lit(0.0))

    return side("x0", "x1") * side("y0", "y1")


def iou(a: str, b: str, crowd: Column | None = None) -> Column:
    """Intersection over union; against a crowd region, over the area of `a` alone."""
    inter = intersection(a, b)

    def size(c: str) -> Column:
        return area(*[F.col(f"{c}.{f}") for f in ("x0", "y0", "x1", "y1")])

    union = size(a) + size(b) - inter
    if crowd is not None:
        union = F.when(crowd, size(a)).otherwise(union)
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def oks(pred: Column, gold: Column, sigmas: list[float], area: Column) -> Column:
    """Object keypoint similarity of two flat (x, y, visibility) arrays.

    Mean over the labelled keypoints of exp(-d^2 / (2 * area * (2*sigma)^2)); NULL when none
    is labelled.
    """
    spread = F.lit([float(s) for s in sigmas])

    def term(s: Column, k: Column) -> Column:
        dx = F.get(pred, 3 * k) - F.get(gold, 3 * k)
        dy = F.get(pred, 3 * k + 1) - F.get(gold, 3 * k + 1)
        e = (dx * dx + dy * dy) / (F.pow(2 * s, F.lit(2.0)) * area * 2.0)
        return F.when(F.get(gold, 3 * k + 2) > 0, F.exp(-e))

    return _mean(F.array_compact(F.transform(spread, term)))


def _mean(values: Column) -> Column:
    """Mean of an array; NULL when it is empty."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def box_keypoint_similarity(pred: Column, x0: Column, y0: Column, x1: Column, y1: Column, sigmas: list[float], area: Column) -> Column:
    """As `oks`, for a box without labelled keypoints: each keypoint's distance from the box with twice its size around it."""
    wide, high = x1 - x0, y1 - y0

    def outside(v: Column, lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0.0), lo - v) + F.greatest(F.lit(0.0), v - hi)

    def term(s: Column, k: Column) -> Column:
        dx = outside(F.get(pred, 3 * k), x0 - wide, x1 + wide)
        dy = outside(F.get(pred, 3 * k + 1), y0 - high, y1 + high)
        return F.exp(-(dx * dx + dy * dy) / (F.pow(2 * s, F.lit(2.0)) * area * 2.0))

    return _mean(F.transform(F.lit([float(s) for s in sigmas]), term))
