"""Panoptic quality and boxes from masks on long pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def panoptic_counts(overlaps: DataFrame, pred: DataFrame, gt: DataFrame) -> DataFrame:
    """`category_id`, tp, fp, fn, iou (sum over matches).

    `overlaps`: image_id, pred_id, gt_id (NULL is void), n pixels. `pred`, `gt`: image_id, segment_id,
    category_id. Segments of one category with IoU above 0.5 match; such matches are unique. Void
    pixels leave the union, and an unmatched prediction that is mostly void is no false positive.
    """
    sums = overlaps.groupBy("image_id", "pred_id").agg(
        F.sum("n").alias("pa"), F.sum(F.when(F.col("gt_id").isNull(), F.col("n")).otherwise(0)).alias("void")
    )
    p = pred.withColumnsRenamed({"segment_id": "pred_id", "category_id": "pc"}).join(sums, ["image_id", "pred_id"])
    ga = overlaps.filter("gt_id IS NOT NULL").groupBy("image_id", "gt_id").agg(F.sum("n").alias("ga"))
    g = gt.withColumnsRenamed({"segment_id": "gt_id", "category_id": "gc"}).join(ga, ["image_id", "gt_id"])
    hits = (
        overlaps.filter("gt_id IS NOT NULL").join(p, ["image_id", "pred_id"]).join(g, ["image_id", "gt_id"])
        .filter("pc = gc")
        .withColumn("iou", F.col("n") / (F.col("pa") + F.col("ga") - F.col("n") - F.col("void")))
        .filter("iou > 0.5")
    )
    tp = hits.select(F.col("pc").alias("category_id"), F.lit("tp").alias("k"), "iou")
    fp = p.join(hits.select("image_id", "pred_id"), ["image_id", "pred_id"], "left_anti").filter(
        F.col("void") / F.col("pa") <= 0.5
    ).select(F.col("pc").alias("category_id"), F.lit("fp").alias("k"), F.lit(0.0).alias("iou"))
    fn = g.join(hits.select("image_id", "gt_id"), ["image_id", "gt_id"], "left_anti").select(
        F.col("gc").alias("category_id"), F.lit("fn").alias("k"), F.lit(0.0).alias("iou")
    )
    return tp.unionByName(fp).unionByName(fn).groupBy("category_id").agg(
        *[F.count_if(F.col("k") == k).alias(k) for k in ("tp", "fp", "fn")], F.sum("iou").alias("iou")
    )


def panoptic_quality(counts: DataFrame, things: DataFrame) -> DataFrame:
    """`kind` (all, things, stuff), n, pq, sq, rq in percent: means over the categories that occur.

    `things`: category_id, isthing.
    """
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    bottom = tp + 0.5 * fp + 0.5 * fn
    per = counts.filter(tp + fp + fn > 0).join(things, "category_id").select(
        "isthing", (F.col("iou") / bottom).alias("pq"),
        F.when(tp > 0, F.col("iou") / tp).otherwise(0.0).alias("sq"), (tp / bottom).alias("rq"),
    )
    kinds = F.explode(F.array(F.lit("all"), F.when(F.col("isthing"), "things").otherwise("stuff")))
    return per.withColumn("kind", kinds).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), *[(F.avg(c) * 100.0).alias(c) for c in ("pq", "sq", "rq")]
    )


def box_from_mask(pixels: DataFrame) -> DataFrame:
    """`image_id`, obj, x0, y0, x1, y1 of every object; the smallest id of an image is background."""
    boxes = pixels.groupBy("image_id", "obj").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )
    back = pixels.groupBy("image_id").agg(F.min("obj").alias("__back"))
    return boxes.join(back, "image_id").filter(F.col("obj") > F.col("__back")).drop("__back")
