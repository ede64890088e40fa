"""Arithmetic on numeric arrays with higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once per row.

    A plain Python variable inside a lambda is inlined into it and computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_total(values: Column, block: int = 128) -> Column:
    """Running sums of an array of numbers. Lists grow by copying, so they are built block by block."""
    def add(acc: Column, x: Column) -> Column:
        at = acc["at"] + x
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    def sums(part: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(part, zero, add)

    zero = F.lit(0).cast("long")
    numbers = values.cast("array<long>")
    def joined(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(block))
        parts = F.transform(starts, lambda s: sums(F.slice(v, s, F.lit(block)), zero))
        def whole(p: Column) -> Column:
            ahead = F.aggregate(p, F.struct(zero.alias("at"), F.array(zero).alias("out")), lambda acc, x: add(acc, x["at"]))
            return F.flatten(F.zip_with(p, F.slice(ahead["out"], F.lit(1), F.size(p)), lambda x, b: F.transform(x["out"], lambda y: y + b)))
        return let(parts, whole)
    return let(numbers, joined)


def as_double(a: Column | str) -> Column:
    return _col(a).cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def log_sum_exp(a: Column | str) -> Column:
    x = as_double(a)
    return let(F.array_max(x), lambda top: top + F.log(total(F.transform(x, lambda v: F.exp(v - top)))))


def log_softmax(a: Column | str) -> Column:
    x = as_double(a)
    return let(log_sum_exp(x), lambda norm: F.transform(x, lambda v: v - norm))


def softmax(a: Column | str) -> Column:
    return F.transform(log_softmax(a), F.exp)


def argmax(a: Column | str) -> Column:
    """0-based index of the first maximum."""
    x = _col(a)
    return (F.array_position(x, F.array_max(x)) - 1).cast("long")


def rank_of(a: Column | str, index: Column | str) -> Column:
    """1-based rank of element `index` by value, larger first, equal values by position."""
    x, i = _col(a), _col(index)

    def rank(own: Column) -> Column:
        return F.size(F.filter(x, lambda v, j: (v > own) | ((v == own) & (j < i)))) + 1

    return let(F.get(x, i.cast("int")), rank).cast("long")


def one_hot(label: Column | str, n: int) -> Column:
    c = _col(label)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == c).cast("int"))


def scale(a: Column | str, kind: str, mean: float = 0.0, std: float = 1.0) -> Column:
    """`unit`: x/255, `signed`: (x-127.5)/127.5, `standard`: (x-mean)/std, `minus_one`: x-1."""
    rules = {
        "unit": lambda v: v / 255.0,
        "signed": lambda v: (v - 127.5) / 127.5,
        "standard": lambda v: (v - F.lit(mean)) / F.lit(std),
        "minus_one": lambda v: v - 1.0,
    }
    return F.transform(as_double(a), rules[kind])


def pad_truncate(a: Column | str, length: int | Column, pad: Column, side: str = "right") -> Column:
    """Cut to `length` from the front of the array and fill up with `pad` on one side."""
    x = _col(a)
    n = F.lit(length) if isinstance(length, int) else length
    kept = F.slice(x, F.lit(1), n.cast("int"))
    fill = F.array_repeat(pad, F.greatest(n - F.size(x), F.lit(0)).cast("int"))
    return F.concat(kept, fill) if side == "right" else F.concat(fill, kept)


def attention_mask(a: Column | str, length: int | Column, side: str = "right") -> Column:
    x = _col(a)
    ones = F.array_repeat(F.lit(1), F.size(x))
    return pad_truncate(ones, length, F.lit(0), side)


def quantize(value: Column | str, edges: list[float]) -> Column:
    """Number of edges at or below the value."""
    v = _col(value)
    flags = F.transform(F.lit(edges), lambda e: (e <= v).cast("int"))
    return F.aggregate(flags, F.lit(0), lambda acc, x: acc + x).cast("long")


def cross_entropy_smoothed(log_probs: Column | str, label: Column | str, eps: float) -> Column:
    """-(sum of target * log-probability), target = (1-eps) one-hot + eps/n."""
    x, i = as_double(log_probs), _col(label)
    at_label = F.element_at(x, (i + 1).cast("int"))
    return -(at_label * (1.0 - eps) + total(x) * F.lit(eps) / F.size(x))
