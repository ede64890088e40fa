"""Set comparison and per-group limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datasheaf.operators.positions import _parse, _sort_cols


def compare_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """`key`, `side`: both, left or right, over the distinct keys; one grouping, no join."""
    a = left.select(key, F.lit(1).alias("__s"))
    b = right.select(key, F.lit(2).alias("__s"))
    sides = a.unionByName(b).groupBy(key).agg(F.bit_or("__s").alias("__s"))
    side = F.when(F.col("__s") == 3, "both").when(F.col("__s") == 1, "left").otherwise("right")
    return sides.select(key, side.alias("side"))


def same_set(left: DataFrame, right: DataFrame, key: str) -> bool:
    return compare_keys(left, right, key).filter("side <> 'both'").isEmpty()


def top_n_per_group(
    df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], n: int, rank: str | None = None
) -> DataFrame:
    """First n rows of each group. Spark cuts every task's share of a group to n before the
    shuffle, so a hot group costs n rows per task."""
    w = Window.partitionBy(*partition_by).orderBy(*_sort_cols(_parse(order_by)))
    out = df.withColumn(rank or "__rn", F.row_number().over(w)).filter(F.col(rank or "__rn") <= n)
    return out if rank else out.drop("__rn")
