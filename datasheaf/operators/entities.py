"""Entity tagging: label alignment, spans and entity scores on tag arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasheaf.functions.arrow import given, lengths, listed, numbers

IGNORE = -100


def subtoken_labels(word_ids: Column, labels: Column, label_all: bool = False) -> Column:
    """Label per piece: the first piece of a word takes the word's label, later pieces take it too
    or -100; special tokens (NULL word) are -100."""
    ignore = F.lit(IGNORE)

    def one(w: Column, i: Column) -> Column:
        own = F.get(labels, w)
        later = F.get(word_ids, i - 1) == w
        value = own if label_all else F.when(F.coalesce(later, F.lit(False)), ignore).otherwise(own)
        return F.when(w.isNull(), ignore).otherwise(value)

    return F.transform(word_ids, one)


def _spans(tags: pa.Array, strict: bool) -> pa.Array:
    sizes, coded = lengths(tags), tags.flatten().dictionary_encode()
    code, names = numbers(coded.indices, -1).astype(np.int64), [*coded.dictionary.to_pylist(), None]
    kinds = [None if t is None else t[2:] for t in names]
    number = {k: i for i, k in enumerate(dict.fromkeys(kinds))}
    kind = np.array([number[k] for k in kinds])
    marks = ("B-",) if strict else ("B-", "I-")
    is_in, is_tag, opens = (np.array([t is not None and x(t) for t in names], bool) for x in (
        lambda t: t.startswith("I-"), lambda t: t != "O", lambda t: t.startswith(marks)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(code)) - (np.cumsum(sizes) - sizes)[row]
    before = code[np.arange(len(code)) - 1] if len(code) else code
    # A tag that does not continue the one before is a head; a head that starts a span ends before the next head.
    head = np.nonzero(~((at > 0) & is_in[code] & is_tag[before] & (kind[before] == kind[code])))[0]
    last = np.r_[head[1:], len(code)][:len(head)] - 1
    start = opens[code[head]]
    head, last = head[start], last[start]
    parts = [pa.array([kinds[c] for c in code[head]], pa.string()), pa.array(at[head].astype(np.int32)), pa.array(at[last].astype(np.int32))]
    spans = pa.StructArray.from_arrays(parts, ["type", "start", "end"])
    return listed(spans, np.bincount(row[head], minlength=len(sizes)), tags)


def entity_spans(tags: str, strict: bool = False) -> Column:
    """Array of (type, start, end) of IOB tags such as `B-LOC`, `I-LOC`, `O` (column name).

    A span starts at `B-`, and, unless strict, at an `I-` that does not continue a span of its type.
    """
    found = F.arrow_udf(lambda tags: _spans(tags, strict), "array<struct<type:string,start:int,end:int>>")
    return found(F.col(tags))


def drop_ignored(tags: Column, labels: Column) -> Column:
    """Tags at the positions whose label is not -100."""
    return F.filter(tags, lambda t, i: F.get(labels, i) != IGNORE)


COUNTS = ("tp", "np", "ng", "hits", "tokens")


def _counts(pred: pa.Array, gold: pa.Array) -> pa.Array:
    """Of each row: spans in both, spans of either, equal tags and tags of `gold`."""
    n = len(pred)
    p, g = _spans(pred, False), _spans(gold, False)
    np_, ng = lengths(p), lengths(g)
    (prow, grow), (p, g) = (np.repeat(np.arange(n), x) for x in (np_, ng)), (p.flatten(), g.flatten())
    # A row has at most one span with a given start.
    place = lambda row, spans: row * 2**31 + numbers(spans.field("start"))
    _, i, j = np.intersect1d(place(prow, p), place(grow, g), assume_unique=True, return_indices=True)
    same = [pc.equal(p.field(c).take(pa.array(i)), g.field(c).take(pa.array(j))) for c in ("type", "end")]
    tp = np.bincount(prow[i][numbers(pc.and_(*same), False).astype(bool)], minlength=n)
    sizes, tokens = lengths(pred), lengths(gold)
    both = np.minimum(sizes, tokens)
    row = np.repeat(np.arange(n), both)
    at = np.arange(len(row)) - (np.cumsum(both) - both)[row]
    of = lambda tags, size: tags.flatten().take(pa.array((np.cumsum(size) - size)[row] + at))
    hits = np.bincount(row[numbers(pc.equal(of(pred, sizes), of(gold, tokens)), False).astype(bool)], minlength=n)
    either = ~(given(pred) & given(gold))
    masks = (either, ~given(pred), ~given(gold), either, ~given(gold))
    columns = [pa.array(x.astype(np.int64), mask=m) for x, m in zip((tp, np_, ng, hits, tokens), masks, strict=True)]
    return pa.StructArray.from_arrays(columns, list(COUNTS))


def entity_scores(df: DataFrame, pred: str, gold: str) -> DataFrame:
    """One row: micro precision, recall, f1 over exact spans, and token accuracy.

    A sentence is one row, so spans are found and compared inside it; only counts are shuffled.
    """
    counted = F.arrow_udf(_counts, ", ".join(f"{c} long" for c in COUNTS))
    s = df.select(counted(F.col(pred), F.col(gold)).alias("c"))
    sums = s.agg(*[F.sum(f"c.{c}").alias(c) for c in COUNTS])
    p = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0)
    r = F.when(F.col("ng") > 0, F.col("tp") / F.col("ng")).otherwise(0.0)
    return sums.select(
        p.alias("precision"), r.alias("recall"),
        F.when(F.col("np") + F.col("ng") > 0, 2.0 * F.col("tp") / (F.col("np") + F.col("ng"))).otherwise(0.0).alias("f1"),
        (F.col("hits") / F.col("tokens")).alias("accuracy"),
    )
