"""Splits, draws and search spaces. Random choice is an md5 of (seed, id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datasheaf.functions.hashing import digest, draw, draw_int
from datasheaf.operators.positions import global_index, group_index, slice_bounds


def shuffled_index(df: DataFrame, id_col: str, seed: int | str, out: str = "pos") -> DataFrame:
    """Dense position of each row in a seeded shuffle."""
    return global_index(df.withColumn("__h", digest(seed, id_col)), ["__h", id_col], out).drop("__h")


def split_three_way(
    df: DataFrame, id_col: str, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 123
) -> DataFrame:
    """`split` train / valid / test with exact sizes: train is floor(n * share), the test part of
    the rest is ceil(rest * test / (test + val))."""
    n = df.count()
    n_train = int(n * train + 1e-9)
    rest = n - n_train
    n_test = -int(-(rest * test / (test + val)) // 1)
    pos = F.col("__pos")
    split = F.when(pos < n_train, "train").when(pos < n - n_test, "valid").otherwise("test")
    return shuffled_index(df, id_col, seed, "__pos").withColumn("split", split).drop("__pos")


def split_threshold(df: DataFrame, id_col: str, shares: dict[str, float], seed: int = 123) -> DataFrame:
    """`split` by thresholds on a draw: approximate sizes, no shuffle."""
    u, top, split = draw(seed, id_col), 0.0, None
    for name, share in shares.items():
        top += share
        split = (F if split is None else split).when(u < top, name)
    return df.withColumn("split", split.otherwise(list(shares)[-1]))


def split_tail(df: DataFrame, order_by: Sequence[str], test: float = 0.2) -> DataFrame:
    """The last ceil(n * test) rows of the order are the test split; nothing is shuffled."""
    n = df.count()
    n_test = -int(-(n * test) // 1)
    return global_index(df, order_by, "__pos").withColumn(
        "split", F.when(F.col("__pos") < n - n_test, "train").otherwise("test")
    ).drop("__pos")


def split_exact(df: DataFrame, id_col: str, n_first: int, names: tuple[str, str], seed: int = 0) -> DataFrame:
    """The first n rows of a seeded shuffle get the first name, the rest the second."""
    return shuffled_index(df, id_col, seed, "__pos").withColumn(
        "split", F.when(F.col("__pos") < n_first, names[0]).otherwise(names[1])
    ).drop("__pos")


def split_classes(df: DataFrame, label: str, portion: float, seed: int = 0) -> DataFrame:
    """Whole classes to validation: int(classes * portion) of them, chosen by draw."""
    classes = df.select(label).distinct()
    n_val = int(classes.count() * portion)
    marked = split_exact(classes, label, n_val, ("validation", "train"), seed)
    return df.join(marked, label)


def dataset_mixture(parts: Sequence[tuple[DataFrame, str, float | int]], order_by: str) -> DataFrame:
    """Rows from the front of each dataset: a share (float) or a count (int), with `subset`."""
    out = None
    for df, name, amount in parts:
        total = df.count()
        hi = int(total * amount) if isinstance(amount, float) else slice_bounds(f"[:{amount}]", total)[1]
        part = global_index(df, order_by, "__pos").filter(F.col("__pos") < hi).drop("__pos")
        part = part.withColumn("subset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def sample_episodes(
    df: DataFrame, member: str, label: str, n_way: int, shots: int, queries: int, tasks: int, seed: int = 0
) -> DataFrame:
    """Few-shot tasks: n classes without replacement, shots + queries members of each without
    replacement, a rotation per class with replacement, relabelled 0..n-1 by `way`.

    Members of a class have positions in a seeded shuffle; a (task, class) takes consecutive
    positions from a drawn start, wrapping round. So members are found by an equi-join on
    (class, position): a class of any size costs only the rows that are drawn from it.
    """
    need = shots + queries
    placed = group_index(df.withColumn("__h", digest(f"{seed}:member", member)), label, ["__h", member], "__pos")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= need)
    drawn = sizes.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).withColumn(
        "__c", digest(f"{seed}:class", "task", label)
    )
    w = Window.partitionBy("task").orderBy("__c", label)
    ways = drawn.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n_way)
    slots = ways.select(
        "task", label, (F.col("__r") - 1).alias("way"), "__n",
        (draw_int(f"{seed}:rotation", "task", label) % 4 * 90).alias("rotation"),
        (draw_int(f"{seed}:start", "task", label) % F.col("__n")).alias("__start"),
        F.explode(F.sequence(F.lit(0), F.lit(need - 1))).alias("slot"),
    ).withColumn("__pos", (F.col("__start") + F.col("slot")) % F.col("__n"))
    role = F.when(F.col("slot") < shots, "support").otherwise("query")
    return slots.join(placed.select(label, "__pos", member), [label, "__pos"]).select(
        "task", "way", label, "rotation", "slot", role.alias("role"), member
    )


def mlm_mask(
    df: DataFrame, row: str, ids: str, mask_id: int, vocab: int, p: float = 0.15, seed: int = 0,
    special: Sequence[int] = (),
) -> DataFrame:
    """Adds `masked` and `labels`: chosen tokens become the mask (80%), a drawn token (10%) or stay;
    labels of the others are -100. Draws depend on (seed, row, position) only."""
    def u(what: str, i: Column) -> Column:
        return draw(f"{seed}:{what}", F.col(row), i)

    def chosen(x: Column, i: Column) -> Column:
        hit = u("pick", i) < p
        return hit & ~x.isin(*special) if special else hit

    def masked(x: Column, i: Column) -> Column:
        how = u("how", i)
        rnd = draw_int(f"{seed}:token", F.col(row), i) % vocab
        return F.when(~chosen(x, i) | (how >= 0.9), x.cast("long")).when(how < 0.8, F.lit(mask_id).cast("long")).otherwise(rnd)

    return df.withColumn("masked", F.transform(ids, masked)).withColumn(
        "labels", F.transform(ids, lambda x, i: F.when(chosen(x, i), x.cast("long")).otherwise(F.lit(-100).cast("long")))
    )


def plm_spans(df: DataFrame, row: str, length: str, p: float, max_span: int, seed: int = 0) -> DataFrame:
    """Spans to predict: the sequence is cut into contexts of max_span/p tokens; each draws a span
    length 1..max_span, cut to context length int(span/p), and a start inside it.

    Contexts have a fixed pitch, so every span is a function of (seed, row, context) alone.
    """
    pitch = int(max_span / p)
    ctx = df.select(
        row, length,
        F.explode(F.expr(f"sequence(0, greatest(`{length}` - 1, 0) div {pitch})")).alias("context"),
    )
    span = draw_int(f"{seed}:span", row, "context") % max_span + 1
    width = F.floor(span / p)
    start = F.col("context") * pitch + draw_int(f"{seed}:start", row, "context") % (width - span + 1)
    return ctx.select(
        row, "context", start.alias("start"), F.least(span, F.col(length) - start).alias("span")
    ).filter(F.col("span") > 0)


def repeat_factors(annotations: DataFrame, threshold: float) -> DataFrame:
    """`image_id`, `factor`: the largest max(1, sqrt(threshold / image frequency)) of its categories."""
    pairs = annotations.select("image_id", "category_id").distinct()
    images = annotations.agg(F.count_distinct("image_id").alias("n"))
    freq = pairs.groupBy("category_id").agg(F.count(F.lit(1)).alias("k")).withColumn("n", images.scalar())
    cat = freq.select(
        "category_id",
        F.greatest(F.lit(1.0), F.sqrt(F.lit(threshold) / (F.col("k") / F.col("n")))).alias("f"),
    )
    return pairs.join(cat, "category_id").groupBy("image_id").agg(F.max("f").alias("factor"))


def repeat_images(factors: DataFrame, seed: int = 0) -> DataFrame:
    """Each image as often as its factor says; the fraction is settled by a draw."""
    whole = F.floor("factor")
    extra = (draw(seed, "image_id") < F.col("factor") - whole).cast("long")
    return factors.withColumn("copies", whole + extra).withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    )


def completion_labels(ids: Column, marker: Sequence[int]) -> Column:
    """Labels of a token array: -100 up to and including the last token of the first marker; all
    -100 when the marker is missing."""
    m, ignore = len(marker), F.lit(-100).cast("long")

    def at(i: Column) -> Column:
        hits = [F.get(ids, (i + k).cast("int")) == F.lit(v) for k, v in enumerate(marker)]
        out = hits[0]
        for h in hits[1:]:
            out = out & h
        return out

    flags = F.transform(ids, lambda _, i: F.coalesce(at(i), F.lit(False)))
    found = F.array_position(flags, F.lit(True))
    cut = F.when(found > 0, found + (m - 1)).otherwise(F.size(ids)).cast("int")
    rest = F.slice(ids, cut + 1, F.size(ids)).cast("array<long>")
    return F.concat(F.array_repeat(ignore, cut), rest)


def sample_hparams(trials: DataFrame, trial: str, space: dict[str, tuple], seed: int = 0) -> DataFrame:
    """A column per hyperparameter: ("int", lo, hi), ("double", lo, hi), ("log", lo, hi) for
    10^U(lo, hi), or ("choice", [values]). Bounds may be columns."""
    def value(name: str, kind: str, *args) -> Column:
        u = draw(f"{seed}:{name}", trial)
        if kind == "choice":
            values = F.lit(list(args[0]))
            return F.get(values, F.floor(u * len(args[0])).cast("int"))
        lo, hi = [a if isinstance(a, Column) else F.lit(a) for a in args]
        if kind == "int":
            return (lo + F.floor(u * (hi - lo + 1))).cast("long")
        x = lo + u * (hi - lo)
        return F.pow(F.lit(10.0), x) if kind == "log" else x

    return trials.select(trial, *[value(n, *spec).alias(n) for n, spec in space.items()])


def grid_hparams(searches: DataFrame, search: str, lists: Sequence[str]) -> DataFrame:
    """One row per combination of the array columns `lists` of each search."""
    out = searches
    for c in lists:
        out = out.withColumn(c, F.explode(c))
    return out.select(search, *lists)
