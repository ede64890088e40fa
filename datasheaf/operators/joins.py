"""Joins and pairings between dataset tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasheaf.functions.hashing import draw_int
from datasheaf.operators.positions import global_index


def bilevel_pairs(df: DataFrame, order_by: Sequence[str], total: int) -> DataFrame:
    """First half of the order against the second half, one to one: structs `a`, `b` and `pos`.

    An odd last row is dropped. Both halves meet on (pos mod half), so one grouping replaces a join.
    """
    half = total // 2
    row = F.struct(*df.columns)
    placed = global_index(df, order_by, "__pos").filter(F.col("__pos") < 2 * half)
    first = F.col("__pos") < half
    return placed.groupBy((F.col("__pos") % F.lit(max(half, 1))).alias("pos")).agg(
        F.max(F.when(first, row)).alias("a"), F.max(F.when(~first, row)).alias("b")
    )


def paired_domains(
    a: DataFrame, a_order: str, b: DataFrame, b_order: str, seed: int | None = None
) -> DataFrame:
    """Row i of the longer domain with rows i mod |A| and i mod |B|; a seed draws the B row instead."""
    na, nb = a.count(), b.count()
    if not na or not nb:
        raise ValueError("both domains need at least one row")
    pos = a.sparkSession.range(max(na, nb)).withColumnRenamed("id", "pos")
    ib = F.col("pos") % nb if seed is None else draw_int(seed, "pos") % nb
    keyed = pos.withColumn("__ia", F.col("pos") % na).withColumn("__ib", ib)
    return (
        keyed.join(global_index(a, a_order, "__ia"), "__ia")
        .join(global_index(b, b_order, "__ib"), "__ib")
        .drop("__ia", "__ib")
    )


def split_by_id_list(pairs: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`split` = dev for listed keys, train for the rest; one pass over the pairs."""
    marks = listed.select(*keys).distinct().withColumn("__in", F.lit(True))
    return pairs.join(marks, list(keys), "left").withColumn(
        "split", F.when(F.col("__in"), "dev").otherwise("train")
    ).drop("__in")


def attach_features(examples: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Every example with each of its windows."""
    return examples.join(features, key)


def align_predictions(predictions: DataFrame, features: DataFrame, index: str = "ind") -> DataFrame:
    """Predictions that arrive in worker order, back on their samples. Repeats of an index (padding
    of the last batch) collapse to one."""
    return features.join(predictions.dropDuplicates([index]), index)


def predictions_vs_references(predictions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Both sides by id with a `side` column: both, prediction or reference."""
    p = predictions.withColumn("__p", F.lit(1))
    r = references.withColumn("__r", F.lit(1))
    side = (
        F.when(F.col("__p").isNull(), "reference").when(F.col("__r").isNull(), "prediction").otherwise("both")
    )
    return p.join(r, key, "full_outer").withColumn("side", side).drop("__p", "__r")


def attach_proposals(images: DataFrame, proposals: DataFrame, image_id: str = "image_id") -> DataFrame:
    """Images with their proposals (id matched as text), best objectness first.

    `proposals`: id, boxes and objectness_logits arrays. An image without proposals fails the job.
    """
    p = proposals.select(
        F.col("id").cast("string").alias("__id"), F.arrays_zip("objectness_logits", "boxes").alias("__z")
    )
    # Descending by score, original position breaks ties.
    keyed = F.transform(
        "__z",
        lambda z, i: F.struct((-z["objectness_logits"]).alias("s"), i.alias("i"), z["boxes"].alias("b")),
    )
    ordered = F.array_sort(keyed)
    joined = images.join(p, F.col(image_id).cast("string") == F.col("__id"), "left")
    ok = F.assert_true(F.col("__id").isNotNull(), F.concat(F.lit("no proposals for image "), F.col(image_id).cast("string")))
    return joined.select(
        *images.columns,
        F.when(ok.isNull(), F.transform(ordered, lambda s: -s["s"])).alias("objectness_logits"),
        F.transform(ordered, lambda s: s["b"]).alias("boxes"),
    )


def merge_counts(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of either side, shared keys summed."""
    return a.unionByName(b).groupBy(key).agg(F.sum(value).alias(value))


def upsert(target: DataFrame, updates: DataFrame, key: str, arrival: str) -> DataFrame:
    """Target rows replaced or extended by the newest update of each key."""
    cols = [c for c in target.columns if c != key]
    newest = updates.groupBy(key).agg(
        F.max_by(F.struct(*cols), arrival).alias("__u")
    ).select(key, *[F.col(f"__u.{c}").alias(c) for c in cols])
    return target.join(newest, key, "left_anti").unionByName(newest)


def lookup(df: DataFrame, mapping: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Adds the mapping's columns by key; with `strict` an unknown key fails the job.

    The mapping must be unique on its key. Spark broadcasts it when it measures it as small.
    """
    marked = mapping.withColumn("__known", F.lit(True))
    out = df.join(marked, key, "left")
    if strict:
        ok = F.assert_true(
            F.col("__known").isNotNull() | F.col(key).isNull(),
            F.concat(F.lit(f"unknown {key} "), F.col(key).cast("string")),
        )
        out = out.filter(ok.isNull())
    return out.drop("__known")


def matched_in_bands(value: Column, bands: Sequence[tuple[str, float, float]]) -> Column:
    """Array of the names of the closed bands [lo, hi] that hold the value."""
    table = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
        for n, lo, hi in bands
    ])
    hit = F.filter(table, lambda r: (value >= r["lo"]) & (value <= r["hi"]))
    return F.transform(hit, lambda r: r["name"])
