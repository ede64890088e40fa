"""Row filters and dataset checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasheaf.functions import text as T
from datasheaf.operators.columns import computed_once
from datasheaf.operators.sets import top_n_per_group

# Word bounds of the difficulty levels, inclusive at both ends.
LENGTH_BANDS = {"easy": (10, 100), "medium": (101, 200), "hard": (201, 800)}


def total_words(columns: Sequence[str]) -> Column:
    """Words over several text columns; a missing text reads as the word `None`."""
    counts = [T.word_count(F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in columns]
    return sum(counts[1:], counts[0])


def length_band(
    df: DataFrame, columns: Sequence[str], level: str, n: int | None, order_by: Sequence[str]
) -> DataFrame:
    """Rows whose total words lie in the level's band, then the first n in source order."""
    lo, hi = LENGTH_BANDS[level]
    out = computed_once(df, "total_length", total_words(columns)).filter(F.col("total_length").between(lo, hi))
    return out if n is None else out.orderBy(*order_by).limit(n)


def length_bands(df: DataFrame, columns: Sequence[str], n: int, order_by: Sequence[str]) -> DataFrame:
    """The first n rows of every level in one pass, with `level` and `total_length`.

    The texts are dropped after counting: join them back by key where they are needed.
    """
    keys = [k.lstrip("-") for k in order_by]
    sized = computed_once(df, "total_length", total_words(columns)).select(*keys, "total_length")
    level = None
    for name, (lo, hi) in LENGTH_BANDS.items():
        level = (F if level is None else level).when(F.col("total_length").between(lo, hi), name)
    leveled = sized.withColumn("level", level).filter(F.col("level").isNotNull())
    return top_n_per_group(leveled, ["level"], order_by, n)


def drop_images_without_usable_annotations(images: DataFrame, annotations: str = "annotations") -> DataFrame:
    """Images with an annotation that is not crowd; a missing flag counts as not crowd."""
    return images.filter(F.exists(annotations, lambda a: F.coalesce(a["iscrowd"], F.lit(0)) == 0))


def images_with_usable_annotations(annotations: DataFrame) -> DataFrame:
    """The same on a normalised annotation table: distinct image ids."""
    return annotations.filter(F.coalesce("iscrowd", F.lit(0)) == 0).select("image_id").distinct()


def visible_keypoints(keypoints: Column) -> Column:
    """Positive visibilities of a flat (x, y, visibility) array."""
    return F.size(F.filter(keypoints, lambda v, i: (i % 3 == 2) & (v > 0)))


def drop_images_with_few_keypoints(annotations: DataFrame, minimum: int) -> DataFrame:
    """`image_id`, `n` of the images that show at least `minimum` keypoints over all annotations."""
    return annotations.groupBy("image_id").agg(
        F.sum(visible_keypoints(F.col("keypoints"))).alias("n")
    ).filter(F.col("n") >= minimum)


def images_with_categories(annotations: DataFrame, category_ids: Sequence[int]) -> DataFrame:
    """Annotations of the images that hold every requested category, labels numbered in list order."""
    wanted = annotations.filter(F.col("category_id").isin(*category_ids))
    full = wanted.groupBy("image_id").agg(F.count_distinct("category_id").alias("k")).filter(
        F.col("k") == len(set(category_ids))
    )
    index = F.array_position(F.lit(list(category_ids)), F.col("category_id")) - 1
    return wanted.join(full.select("image_id"), "image_id", "left_semi").withColumn("label", index.cast("int"))


def score_floor(df: DataFrame, score: str, floor: float = 0.001) -> DataFrame:
    """Detections down to the first score below the floor. Scores descend within an image, so this
    is a plain filter, pushed down to the scan."""
    return df.filter(F.col(score) >= floor)


# Limits of the architecture search.
MAX_SKIP, MIN_CONV, MIN_PARAMS, MAX_PARAMS = 3, 3, 2.5e6, 4.5e6


def arch_constraints(trials: DataFrame, trial: str, operators: Sequence[str], params: str) -> DataFrame:
    """`trial`, `reason`: the first violated rule of each architecture, NULL when it is allowed.

    Operator columns are told apart by `normal` and `reduce` in their names; counting is row-local.
    """
    def count(op: str, cell: str) -> Column:
        flags = [(F.col(c) == op).cast("int") for c in operators if cell in c]
        return sum(flags[1:], flags[0]) if flags else F.lit(0)

    ns, rs = count("skip_connect", "normal"), count("skip_connect", "reduce")
    nc = count("sep_conv_3x3", "normal")
    reason = (
        F.when((ns >= MAX_SKIP) | (rs >= MAX_SKIP), "too many skip")
        .when((ns == 0) | (rs == 0), "too few skip")
        .when(nc < MIN_CONV, "too few conv")
        .when((F.col(params) < MIN_PARAMS) | (F.col(params) > MAX_PARAMS), "parameters out of range")
    )
    return trials.select(trial, reason.alias("reason"))


def hp_constraint(a: Column, b: Column, gap: float = 10) -> Column:
    """Configurations whose two filter counts differ by at least the gap."""
    return F.abs(b - a) >= gap


# States in which an experiment has ended.
TERMINAL_STATES = ("COMPLETED", "CANCELED", "DELETED", "ERROR")


def archivable(archived: Column, state: Column) -> Column:
    return ~archived & state.isin(*TERMINAL_STATES)


def preference_violations(df: DataFrame) -> DataFrame:
    """Adds `violation` to chat preferences (message arrays chosen, rejected); NULL when sound."""
    def incomplete(c: str) -> Column:
        return F.exists(c, lambda m: m["role"].isNull() | m["content"].isNull()) | (F.size(c) < 1)

    def prompt(c: str) -> Column:
        return F.array_join(
            F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), lambda m: m["content"]), ". "
        )

    reason = (
        F.when(F.col("chosen").isNull() | F.col("rejected").isNull(), "missing side")
        .when(incomplete("chosen") | incomplete("rejected"), "incomplete message")
        .when(prompt("chosen") != prompt("rejected"), "prompts differ")
        .when(F.exists("chosen", lambda m: m["role"] == "system"), "system role")
    )
    return df.withColumn("violation", reason)


def split_failed(df: DataFrame, parsed: Column, name: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows whose mapper gave a value, and the rows it failed on; none is replaced."""
    tried = df.withColumn(name, parsed)
    return tried.filter(F.col(name).isNotNull()), tried.filter(F.col(name).isNull())
