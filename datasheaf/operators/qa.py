"""Span question answering: answer positions, candidates, n-best lists, null answers, EM and F1.

A feature row is one window of one example. Candidate spans come from at most n starts times n ends
of the same window and are built inside the row; only the n best of a window leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datasheaf.functions import text as T
from datasheaf.functions.arrow import given, lengths, listed, numbers, stretches
from datasheaf.operators.positions import running_many
from datasheaf.session import written

# The fallbacks of an example without any candidate.
EMPTY_TEXT = "empty"
BEAM_EMPTY_START, BEAM_EMPTY_END = -1e-6, -2e-6


def _word_offsets(words: pa.Array) -> pa.Array:
    sizes, n = lengths(words), pc.add(pc.utf8_length(words.flatten()), 1)
    steps = numbers(n).astype(np.int64)
    ends = np.cumsum(steps)
    starts = np.r_[0, ends]
    before = np.repeat(starts[np.cumsum(sizes) - sizes], sizes)
    # From a missing word on no position is known.
    lost = np.r_[0, np.cumsum(~given(n))]
    unknown = lost[1:] > np.repeat(lost[np.cumsum(sizes) - sizes], sizes)
    s = pa.array((ends - steps - before).astype(np.int32), mask=unknown)
    e = pa.array((ends - 1 - before).astype(np.int32), mask=unknown)
    return listed(pa.StructArray.from_arrays([s, e], ["s", "e"]), sizes, words)


def word_offsets(words: Column) -> Column:
    """Character span of each word in the text that joins the words with single blanks."""
    return F.arrow_udf(_word_offsets, "array<struct<s:int,e:int>>")(words)


def _largest(lists: pa.Array, n: int) -> tuple[np.ndarray, ...]:
    """For each list the positions of its n largest numbers, equal ones by position, missing ones in front:
    tables of the positions, of whether there is one, of its number and of whether that is given."""
    sizes, flat = lengths(lists), lists.flatten()
    inside = np.arange(sizes.max(initial=0)) < sizes[:, None]
    value = np.full(inside.shape, np.nan)
    value[inside] = numbers(flat)
    known = ~inside
    known[inside] = given(flat)
    order = np.argsort(-value, axis=1, kind="stable") if known.all() else np.lexsort((-value, known), axis=1)
    at = order[:, :n]
    return at, np.arange(at.shape[1]) < sizes[:, None], np.take_along_axis(value, at, 1), np.take_along_axis(known, at, 1)


_SPAN = "struct<start:int,end:int,score:double,start_logit:double,end_logit:double,lo:int,hi:int>"


def _pairs(starts: pa.Array, ends: pa.Array, offsets: pa.Array, n: int, max_len: int, best: int | None) -> pa.Array:
    """Valid spans of each row, best score first: both ends among the n best and inside the context, end not
    before start, length bounded; `lo` and `hi` bound the text."""
    s, has_s, s_logit, s_given = _largest(starts, n)
    e, has_e, e_logit, e_given = _largest(ends, n)
    sizes, tokens = lengths(offsets), offsets.flatten()
    known = np.zeros((len(sizes), max(lengths(starts).max(initial=0), lengths(ends).max(initial=0), sizes.max(initial=0))), bool)
    known[np.arange(known.shape[1]) < sizes[:, None]] = given(tokens)
    has_s, has_e = has_s & np.take_along_axis(known, s, 1), has_e & np.take_along_axis(known, e, 1)
    length = e[:, None, :] - s[:, :, None]
    row, i, j = np.nonzero(has_s[:, :, None] & has_e[:, None, :] & (length >= 0) & (length < max_len))
    start, end, start_logit, end_logit = s[row, i], e[row, j], s_logit[row, i], e_logit[row, j]
    both = s_given[row, i] & e_given[row, j]
    order = np.lexsort((end, start, -(start_logit + end_logit), both, row))
    found = np.bincount(row, minlength=len(sizes))
    if best is not None:
        nth = np.arange(len(row)) - np.repeat(np.cumsum(found) - found, found)
        order, found = order[nth < best], np.minimum(found, best)
    row, i, j, start, end, both, start_logit, end_logit = (x[order] for x in (row, i, j, start, end, both, start_logit, end_logit))
    first = np.cumsum(sizes) - sizes
    columns = {
        "start": pa.array(start.astype(np.int32)), "end": pa.array(end.astype(np.int32)),
        "score": pa.array(start_logit + end_logit, mask=~both),
        "start_logit": pa.array(start_logit, mask=~s_given[row, i]), "end_logit": pa.array(end_logit, mask=~e_given[row, j]),
        "lo": tokens.field("s").take(pa.array(first[row] + start)), "hi": tokens.field("e").take(pa.array(first[row] + end)),
    }
    return listed(pa.StructArray.from_arrays(list(columns.values()), list(columns)), found)


def span_candidates(features: DataFrame, n: int = 20, max_len: int = 30, best: int | None = None) -> DataFrame:
    """One row per candidate span with its answer `text`; with `best`, that many per window.

    `features`: start_logits, end_logits, offsets, context; other columns are kept. The context
    stays behind: a candidate carries its own text only. The spans of many windows are found together.
    """
    used = ("start_logits", "end_logits", "offsets", "context")
    keep = [c for c in features.columns if c not in used]

    @F.arrow_udf(f"array<{_SPAN}>")
    def spans(starts: pa.Array, ends: pa.Array, offsets: pa.Array) -> pa.Array:
        widths = np.maximum(np.maximum(lengths(starts), lengths(ends)), lengths(offsets))
        return pa.concat_arrays([_pairs(starts[at], ends[at], offsets[at], n, max_len, best) for at in stretches(widths)])

    double = lambda c: F.col(c).cast("array<double>")
    offsets = F.col("offsets").cast("array<struct<s:int,e:int>>")
    # Made in the generator itself: a filter on a column of lists would make them a second time.
    rows = features.select(*keep, "context", F.explode(spans(double("start_logits"), double("end_logits"), offsets)).alias("__c"))
    text = F.substring("context", F.col("__c.lo") + 1, F.col("__c.hi") - F.col("__c.lo"))
    return rows.select(*keep, *[f"__c.{c}" for c in ("start", "end", "score", "start_logit", "end_logit")], text.alias("text"))


def _text(context: str, offsets: str, start: Column, end: Column) -> Column:
    lo, hi = F.get(offsets, start)["s"], F.get(offsets, end)["e"]
    return F.substring(F.col(context), lo + 1, hi - lo)


def beam_candidates(features: DataFrame, start_n: int, end_n: int, max_len: int = 30) -> DataFrame:
    """Start i with its own ends j at index i * end_n + j, with `text`; columns start_top_log_probs,
    start_top_index, end_top_log_probs, end_top_index, offsets, context."""
    used = {"start_top_log_probs", "start_top_index", "end_top_log_probs", "end_top_index", "offsets", "context"}
    keep = [c for c in features.columns if c not in used]

    def row(k: Column) -> Column:
        i = F.floor(k / end_n).cast("int")
        start, end = F.get("start_top_index", i), F.get("end_top_index", k)
        s, e = F.get("start_top_log_probs", i), F.get("end_top_log_probs", k)
        return F.struct(
            start.alias("start"), end.alias("end"), s.alias("start_logit"), e.alias("end_logit"),
            (s + e).alias("score"), _text("context", "offsets", start, end).alias("text"),
        )

    def valid(k: Column) -> Column:
        start, end = F.get("start_top_index", F.floor(k / end_n).cast("int")), F.get("end_top_index", k)
        return (
            F.get("offsets", start).isNotNull() & F.get("offsets", end).isNotNull()
            & (end >= start) & (end - start + 1 <= max_len)
        )

    ks = F.filter(F.sequence(F.lit(0), F.lit(start_n * end_n - 1)), valid)
    return features.select(*keep, F.explode(F.transform(ks, row)).alias("__c")).select(*keep, "__c.*")


def null_scores(features: DataFrame, key: str) -> DataFrame:
    """`key`, null_score, null_start, null_end: the smallest score of position 0 over the windows."""
    s, e = F.get("start_logits", F.lit(0)), F.get("end_logits", F.lit(0))
    best = F.min(F.struct((s + e).alias("score"), F.col("window"), s.alias("s"), e.alias("e")))
    return features.groupBy(key).agg(best.alias("b")).select(
        key, F.col("b.score").alias("null_score"), F.col("b.s").alias("null_start"), F.col("b.e").alias("null_end")
    )


def n_best(candidates: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The n best candidates of each example with `rank`.

    Order: score, then window, start, end. Each task passes on at most n rows per example.
    """
    w = Window.partitionBy(key).orderBy(F.desc("score"), "window", "start", "end")
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def with_fallback(
    nbest: DataFrame, examples: DataFrame, key: str, text: str = EMPTY_TEXT, start: float = 0.0, end: float = 0.0
) -> DataFrame:
    """Every example once at least: one without candidates, or with a single empty text, gets the
    fallback in front.

    The fallbacks of all examples are put beside the lists and those not needed are left out again, so
    the lists are made once.
    """
    fake = examples.select(key).distinct().select(
        key, F.lit(0).alias("rank"), F.lit(text).alias("text"), F.lit(start + end).alias("score"),
        F.lit(start).alias("start_logit"), F.lit(end).alias("end_logit"),
    )
    both = nbest.select(*fake.columns, F.lit(0).alias("__fake")).unionByName(fake.withColumn("__fake", F.lit(1)))
    real, own = F.col("__fake") == 0, Window.partitionBy(key)
    counted = both.withColumn("__n", F.count_if(real).over(own)).withColumn("__empty", F.count_if(real & (F.col("text") == "")).over(own))
    # A missing key equals no other.
    needed = F.col(key).isNull() | (F.col("__n") == 0) | ((F.col("__n") == 1) & (F.col("__empty") == 1))
    return counted.filter(real | needed).drop("__fake", "__n", "__empty")


def group_softmax(df: DataFrame, key: str, score: str, out: str = "probability") -> DataFrame:
    """Softmax of the scores inside each group.

    The group's maximum and mass are aggregates joined back, so no group is gathered.
    """
    top = df.groupBy(key).agg(F.max(score).alias("__top"))
    shifted = df.join(top, key).withColumn("__x", F.exp(F.col(score) - F.col("__top")))
    mass = shifted.groupBy(key).agg(F.sum("__x").alias("__mass"))
    return shifted.join(mass, key).withColumn(out, F.col("__x") / F.col("__mass")).drop("__x", "__mass", "__top")


def with_null(nbest: DataFrame, nulls: DataFrame, key: str, n: int = 20) -> DataFrame:
    """N-best lists with the null answer in its place, appended when its score misses the cut."""
    null_rows = nulls.select(
        key, F.lit("").alias("text"), F.col("null_score").alias("score"), F.col("null_start").alias("start_logit"),
        F.col("null_end").alias("end_logit"), F.lit(1).alias("is_null"), F.lit(n + 1).alias("rank"),
    )
    real = nbest.select(
        key, "text", "score", "start_logit", "end_logit", F.lit(0).alias("is_null"), F.col("rank")
    )
    w = Window.partitionBy(key).orderBy(F.desc("score"), "is_null", "rank")
    ranked = real.unionByName(null_rows).withColumn("rank", F.row_number().over(w))
    return ranked.filter((F.col("rank") <= n) | (F.col("is_null") == 1))


def null_answer(nbest: DataFrame, nulls: DataFrame, key: str, threshold: float = 0.0) -> DataFrame:
    """`key`, answer, score_diff: empty when the null score beats the best non-empty candidate by
    more than the threshold."""
    best = nbest.filter(F.col("text") != "").groupBy(key).agg(
        F.min_by(F.struct("text", "start_logit", "end_logit"), "rank").alias("b")
    )
    diff = F.col("null_score") - F.coalesce("b.start_logit", F.lit(0.0)) - F.coalesce("b.end_logit", F.lit(0.0))
    out = nulls.join(best, key, "left").withColumn("score_diff", diff)
    answer = F.when(F.col("score_diff") > threshold, "").otherwise(F.coalesce("b.text", F.lit(EMPTY_TEXT)))
    return out.select(key, answer.alias("answer"), "score_diff")


def beam_answer(nbest: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """`key`, answer (first n-best text), no_answer (smallest CLS logit, reported only)."""
    first = nbest.groupBy(key).agg(F.min_by("text", "rank").alias("answer"))
    cls = features.groupBy(key).agg(F.min("cls_logit").alias("no_answer"))
    return cls.join(first, key, "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def _token_span(offsets: pa.Array, start_char: pa.Array, end_char: pa.Array, cls_index: pa.Array) -> pa.Array:
    sizes, tokens = lengths(offsets), offsets.flatten()
    first, far = np.cumsum(sizes) - sizes, np.iinfo(np.int64).max
    at = np.arange(len(tokens)) - np.repeat(first, sizes)
    s, e = (numbers(tokens.field(c)).astype(np.int64) for c in "se")
    ctx = given(tokens) & given(tokens.field("s"))
    ends = ctx & given(tokens.field("e"))
    lo, hi = (numbers(c).astype(np.int64) for c in (start_char, end_char))

    def of_rows(pick: np.ufunc, values: np.ndarray, none: int) -> np.ndarray:
        out = np.full(len(sizes), none)
        if len(values):
            out[sizes > 0] = pick.reduceat(values, first[sizes > 0])
        return out

    # last token that starts at or before the span, first token that ends at or after it
    start = of_rows(np.maximum, np.where(ctx & (s <= np.repeat(lo, sizes)), at, -1), -1)
    end = of_rows(np.minimum, np.where(ends & (e >= np.repeat(hi, sizes)), at, far), far)
    hit = given(start_char) & given(end_char) & (start >= 0) & (end < far)
    outside = ~hit & ~given(cls_index)
    cls = numbers(cls_index).astype(np.int64)
    parts = [pa.array(np.where(hit, x, cls).astype(np.int32), mask=outside) for x in (start, end)]
    return pa.StructArray.from_arrays(parts, ["start", "end"])


def answer_token_span(offsets: Column, start_char: Column, end_char: Column, cls_index: Column) -> Column:
    """Struct (start, end): token positions of a character span, or the CLS position twice when the
    span is not inside the window. Offsets are NULL outside the context."""
    found = F.arrow_udf(_token_span, "struct<start:int,end:int>")
    return found(offsets.cast("array<struct<s:int,e:int>>"), start_char.cast("long"), end_char.cast("long"), cls_index.cast("int"))


def context_offsets(offsets: Column, is_context: Column) -> Column:
    """Offsets with NULL for every token outside the context."""
    return F.zip_with(offsets, is_context, lambda o, c: F.when(c, o))


def p_mask(is_context: Column, cls_index: Column) -> Column:
    """0 for context tokens and CLS, 1 otherwise."""
    return F.transform(is_context, lambda c, i: F.when(c | (i == cls_index), 0).otherwise(1))


def squad_scores(df: DataFrame, id_col: str, prediction: str, golds: str) -> DataFrame:
    """`id`, em, f1 of each prediction: the best over its gold answers (array), in 0..1.

    Word overlap counts duplicates: the multiset is counted per answer with map-side combine.
    """
    norm = df.select(
        id_col, T.squad_normalize(prediction).alias("p"),
        F.posexplode(F.transform(golds, lambda g: T.squad_normalize(g))).alias("g_no", "g"),
    ).withColumn("pw", T.words("p")).withColumn("gw", T.words("g"))
    pairs = norm.select(
        id_col, "g_no", (F.col("p") == F.col("g")).cast("int").alias("em"),
        F.size("pw").alias("np"), F.size("gw").alias("ng"),
    )
    sides = norm.select(
        id_col, "g_no",
        F.explode(F.concat(
            F.transform("pw", lambda w: F.struct(w.alias("w"), F.lit(1).alias("p"))),
            F.transform("gw", lambda w: F.struct(w.alias("w"), F.lit(0).alias("p"))),
        )).alias("s"),
    )
    counts = sides.groupBy(id_col, "g_no", "s.w").agg(
        F.sum("s.p").alias("cp"), F.sum(1 - F.col("s.p")).alias("cg")
    )
    common = counts.groupBy(id_col, "g_no").agg(F.sum(F.least("cp", "cg")).alias("same"))
    same = F.coalesce("same", F.lit(0))
    f1 = (
        F.when((F.col("np") == 0) | (F.col("ng") == 0), (F.col("np") == F.col("ng")).cast("double"))
        .otherwise(2.0 * same / (F.col("np") + F.col("ng")))
    )
    scored = pairs.join(common, [id_col, "g_no"], "left").withColumn("f1", f1)
    return scored.groupBy(id_col).agg(F.max("em").alias("em"), F.max("f1").alias("f1"))


def squad_em_f1(df: DataFrame, id_col: str, prediction: str, golds: str) -> DataFrame:
    """One row: exact_match and f1 in percent; an example without gold answers is scored against
    the empty answer."""
    full = df.withColumn(golds, F.when(F.size(golds) > 0, F.col(golds)).otherwise(F.array(F.lit(""))))
    s = squad_scores(full, id_col, prediction, golds)
    return s.agg(
        (F.avg("em") * 100).alias("exact_match"), (F.avg("f1") * 100).alias("f1"), F.count(F.lit(1)).alias("total")
    )


def squad_thresholds(df: DataFrame, id_col: str, prediction: str, golds: str, odds: str) -> DataFrame:
    """One row: scores in percent, over all examples and by answerability, and the best threshold for each.

    total, exact, f1, HasAns_total, HasAns_exact, HasAns_f1, NoAns_total, NoAns_exact, NoAns_f1, best_exact,
    best_exact_thresh, best_f1, best_f1_thresh. An example without gold answers has none. A prediction is
    taken as no answer where its null odds (`odds`) are above a threshold; the best one is the smallest at
    which the mean score is highest, 0 where no answer at all is best. Examples of equal odds go together.
    """
    has = F.size(golds) > 0
    full = df.withColumn(golds, F.when(has, F.col(golds)).otherwise(F.array(F.lit(""))))
    marked = df.select(id_col, has.alias("has"), (F.col(prediction) != "").alias("said"), F.col(odds).cast("double").alias("odds"))
    s = written(squad_scores(full, id_col, prediction, golds).join(marked, id_col), "scores")
    mean = lambda c, kind: (F.avg(F.when(kind, F.col(c))) * 100)
    kinds = {"": F.lit(True), "HasAns_": F.col("has"), "NoAns_": ~F.col("has")}
    means = s.agg(*[x for k, kind in kinds.items() for x in (
        F.count_if(kind).alias(f"{k}total"), mean("em", kind).alias(f"{k}exact"), mean("f1", kind).alias(f"{k}f1"))])
    # Up to a threshold, answerable examples gain their score and the others lose the point they have unanswered.
    gain = lambda c: F.sum(F.when(F.col("has"), F.col(c)).otherwise(-F.col("said").cast("double")))
    gains = s.groupBy("odds").agg(gain("em").alias("em"), gain("f1").alias("f1"))
    run = running_many(gains, {"em_sum": F.col("em"), "f1_sum": F.col("f1")}, "odds")
    best = run.agg(*[F.max(F.struct(F.col(f"{c}_sum").alias("s"), (-F.col("odds")).alias("o"))).alias(c) for c in ("em", "f1")])
    # One row each, put side by side.
    row = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    both = row(means, "m").unionByName(row(best, "b"), allowMissingColumns=True)
    out = both.agg(F.max("m").alias("m"), F.max("b").alias("b")).select("m.*", "b.em", F.col("b.f1").alias("f1_best"))
    for c, name in (("em", "exact"), ("f1_best", "f1")):
        better = F.col(f"{c}.s") > 0
        out = out.withColumns({
            f"best_{name}": (F.col("NoAns_total") + F.when(better, F.col(f"{c}.s")).otherwise(0.0)) * 100 / F.col("total"),
            f"best_{name}_thresh": F.when(better, -F.col(f"{c}.o")).otherwise(0.0),
        })
    return out.select(*[f"{k}{c}" for k in kinds for c in ("total", "exact", "f1")],
                                 "best_exact", "best_exact_thresh", "best_f1", "best_f1_thresh")
