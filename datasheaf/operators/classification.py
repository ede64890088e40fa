"""Classification and regression metrics as plain aggregates over prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasheaf.functions.arrays import rank_of
from datasheaf.operators.positions import running
from datasheaf.session import written


def accuracy(pred: str, label: str) -> Column:
    return F.avg((F.col(pred) == F.col(label)).cast("int"))


def topk_accuracy(scores: str, label: str, k: int) -> Column:
    """Percent of rows whose label is among the k best scores."""
    return F.avg((rank_of(scores, label) <= k).cast("int")) * 100.0


def confusion_matrix(
    df: DataFrame, pred: str, gt: str, ignore: int | None = None, classes: int | None = None
) -> DataFrame:
    """`pred`, `gt`, `n`; the ignored label becomes class number `classes`."""
    g = F.col(gt)
    if ignore is not None:
        g = F.when(g == ignore, F.lit(classes)).otherwise(g)
    return df.groupBy(F.col(pred).alias("pred"), g.alias("gt")).agg(F.count(F.lit(1)).alias("n"))


def per_class_counts(matrix: DataFrame, classes: DataFrame) -> DataFrame:
    """`label`, tp, fp, fn of every class in `classes(label)`, members or not."""
    same = F.col("pred") == F.col("gt")
    sides = matrix.select(
        F.explode(
            F.when(same, F.array(F.struct(F.col("gt").alias("label"), F.lit("tp").alias("k"))))
            .otherwise(F.array(
                F.struct(F.col("pred").alias("label"), F.lit("fp").alias("k")),
                F.struct(F.col("gt").alias("label"), F.lit("fn").alias("k")),
            ))
        ).alias("s"), "n",
    ).select("s.label", "s.k", "n")
    counts = sides.groupBy("label").agg(
        *[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(k) for k in ("tp", "fp", "fn")]
    )
    return classes.select("label").join(counts, "label", "left").fillna(0, ["tp", "fp", "fn"])


def per_class_f1(matrix: DataFrame, classes: DataFrame) -> DataFrame:
    """tp / (tp + (fp + fn) / 2); NULL for a class without members and predictions."""
    c = per_class_counts(matrix, classes)
    bottom = F.col("tp") + 0.5 * (F.col("fp") + F.col("fn"))
    return c.withColumn("f1", F.when(bottom > 0, F.col("tp") / bottom))


def sem_seg_metrics(matrix: DataFrame, classes: DataFrame, ignore_class: int) -> tuple[DataFrame, DataFrame]:
    """Per-class IoU / ACC and the summary mIoU, fwIoU, mACC, pACC, in percent.

    The ignore row and column are left out. mIoU sums over classes with ground truth and divides by
    the number of classes with ground truth or predictions.
    """
    inner = matrix.filter((F.col("pred") != ignore_class) & (F.col("gt") != ignore_class))
    c = per_class_counts(inner, classes.filter(F.col("label") != ignore_class))
    gt, pr = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")
    per = c.select(
        "label", "tp", gt.alias("pos_gt"), pr.alias("pos_pred"),
        F.when(gt > 0, 100.0 * F.col("tp") / (gt + pr - F.col("tp"))).alias("iou"),
        F.when(gt > 0, 100.0 * F.col("tp") / gt).alias("acc"),
    )
    whole = F.sum("pos_gt")
    summary = per.agg(
        (F.sum("iou") / F.count_if(F.col("pos_gt") + F.col("pos_pred") > 0)).alias("miou"),
        (F.sum(F.col("iou") * F.col("pos_gt")) / whole).alias("fwiou"),
        F.avg("acc").alias("macc"),
        (100.0 * F.sum("tp") / whole).alias("pacc"),
    )
    return per, summary


def binary_counts(pred: str, label: str) -> dict[str, Column]:
    p, y = F.col(pred) == 1, F.col(label) == 1
    return {
        "tp": F.count_if(p & y), "fp": F.count_if(p & ~y), "fn": F.count_if(~p & y), "tn": F.count_if(~p & ~y),
    }


def f1_binary(pred: str, label: str) -> Column:
    c = binary_counts(pred, label)
    bottom = 2 * c["tp"] + c["fp"] + c["fn"]
    return F.when(bottom > 0, 2 * c["tp"] / bottom)


def matthews(pred: str, label: str) -> Column:
    """Matthews correlation of a binary prediction; 0 when a margin is empty."""
    c = {k: v.cast("double") for k, v in binary_counts(pred, label).items()}
    bottom = (
        (c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"])
    )
    top = c["tp"] * c["tn"] - c["fp"] * c["fn"]
    return F.when(bottom > 0, top / F.sqrt(bottom)).otherwise(0.0)


def average_ranks(values: DataFrame, col: str, n: Column | None = None) -> DataFrame:
    """`col`, `rank`: mean rank of each distinct value, from a running count of the distinct values.

    `n` says how often a row counts.
    """
    counts = values.groupBy(col).agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias("__n"))
    below = running(counts, F.col("__n"), col, inclusive=False, out="__below")
    return below.select(col, (F.col("__below") + (F.col("__n") + 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row `spearman`: Pearson correlation of the average ranks.

    Equal (x, y) pairs are counted first, so a frequent value never makes a hot join key, and written once:
    the input is read no more after that.
    """
    pairs = written(df.select(x, y).dropna().groupBy(x, y).agg(F.count(F.lit(1)).alias("n")), "pairs")
    rx = average_ranks(pairs, x, F.col("n")).withColumnRenamed("rank", "rx")
    ry = average_ranks(pairs, y, F.col("n")).withColumnRenamed("rank", "ry")
    j = pairs.join(rx, x).join(ry, y)
    n, a, b = F.col("n"), F.col("rx"), F.col("ry")
    s = {
        "n": F.sum(n), "a": F.sum(n * a), "b": F.sum(n * b),
        "ab": F.sum(n * a * b), "aa": F.sum(n * a * a), "bb": F.sum(n * b * b),
    }
    cov = s["ab"] - s["a"] * s["b"] / s["n"]
    va, vb = s["aa"] - s["a"] * s["a"] / s["n"], s["bb"] - s["b"] * s["b"] / s["n"]
    return j.agg(F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("spearman"))


# The metrics of each text-classification task.
TASK_METRICS = {
    "cola": ["matthews"], "mnli": ["accuracy"], "mrpc": ["accuracy", "f1"], "qnli": ["accuracy"],
    "qqp": ["accuracy", "f1"], "rte": ["accuracy"], "sst2": ["accuracy"], "stsb": ["pearson", "spearman"],
    "wnli": ["accuracy"], "xnli": ["accuracy"],
}


def task_metrics(df: DataFrame, task: str, pred: str, label: str) -> DataFrame:
    """One row with the task's metrics, and `combined_score`, their mean, when there are several."""
    names = TASK_METRICS[task]
    exprs = {
        "accuracy": accuracy(pred, label), "f1": f1_binary(pred, label),
        "matthews": matthews(pred, label), "pearson": F.corr(pred, label),
    }
    out = df.agg(*[exprs[n].alias(n) for n in names if n != "spearman"])
    if "spearman" in names:
        out = out.withColumn("spearman", spearman(df, pred, label).scalar())
    if len(names) > 1:
        out = out.withColumn("combined_score", sum([F.col(n) for n in names[1:]], F.col(names[0])) / len(names))
    return out


def validated_selection(counts: DataFrame, param: str) -> DataFrame:
    """The parameter with most validation hits (smallest on ties) and its test accuracy."""
    sums = counts.groupBy(param).agg(
        F.sum("val_correct").alias("val_correct"), F.sum("test_correct").alias("test_correct"),
        F.sum("test_count").alias("test_count"),
    )
    best = F.max_by(
        F.struct(param, "val_correct", "test_correct", "test_count"),
        F.struct(F.col("val_correct"), -F.col(param)),
    )
    return sums.agg(best.alias("b")).select(
        f"b.{param}", "b.val_correct", (F.col("b.test_correct") / F.col("b.test_count")).alias("test_accuracy")
    )


def class_histogram(counts: DataFrame, classes: DataFrame, name: str = "name") -> DataFrame:
    """`name`, `n` for every class, zero classes included, and a `total` row; long names cut."""
    from datasheaf.functions.text import abbreviate

    full = classes.select(name).join(counts.select(name, "n"), name, "left").fillna(0, ["n"])
    rows = full.rollup(name).agg(F.sum("n").alias("n"), F.grouping_id().alias("__g"))
    label = F.when(F.col("__g") == 1, "total").otherwise(abbreviate(name))
    return rows.select(label.alias(name), "n")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """`bin`, `lo`, `n`: equal-width bins on [min, max], the last one closed; empty bins left out."""
    lims = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = (lims.select(c).scalar() for c in ("lo", "hi"))
    width = (hi - lo) / F.lit(float(bins))
    raw = F.when(width > 0, F.floor((F.col(value) - lo) / width)).otherwise(0)
    b = F.least(raw, F.lit(bins - 1)).cast("long")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "lo", lo + F.col("bin") * width
    )


def label_stats(df: DataFrame, col: str, approximate: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(f(col).alias("num_labels"), F.min(col).alias("first"), F.max(col).alias("last"))


def range_check(df: DataFrame, label: str, model_classes: int) -> DataFrame:
    """Compares the largest label with the number of model classes."""
    top = F.max(label)
    status = F.when(top > model_classes, "error").when(top < model_classes, "warning").otherwise("ok")
    return df.agg(top.alias("max_label"), status.alias("status"))


def timing_summary(
    df: DataFrame, group: Sequence[str], repeat: str, seconds: str, flops: Column
) -> DataFrame:
    """Mean and sample deviation of seconds and TFLOP/s; the slowest rank stands for a repeat."""
    worst = df.groupBy(*group, repeat).agg(F.max(seconds).alias("s"))
    rate = flops / F.col("s") / 1e12
    return worst.groupBy(*group).agg(
        F.avg("s").alias("mean_s"), F.stddev_samp("s").alias("std_s"),
        F.avg(rate).alias("mean_tflops"), F.stddev_samp(rate).alias("std_tflops"),
    )
