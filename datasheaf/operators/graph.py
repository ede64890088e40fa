"""Per-graph message passing, pooling and readout on node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasheaf.operators.positions import group_index
from datasheaf.session import written


def neighbor_sum(nodes: DataFrame, edges: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per node the sum of its in-neighbours' features."""
    src = nodes.select("graph_id", F.col("node_id").alias("src"), *features)
    return edges.join(src, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(
        *[F.sum(f).alias(f) for f in features]
    )


def topk_pool(nodes: DataFrame, edges: DataFrame, score: str, ratio: float) -> tuple[DataFrame, DataFrame]:
    """The ceil(ratio * n) best scored nodes of each graph and the edges between kept nodes."""
    ranked = group_index(nodes, "graph_id", ["-" + score, "node_id"], "__rank")
    sizes = nodes.groupBy("graph_id").agg(F.ceil(F.count(F.lit(1)) * F.lit(ratio)).alias("__keep"))
    kept = ranked.join(sizes, "graph_id").filter("__rank < __keep").drop("__rank", "__keep")
    ids = kept.select("graph_id", "node_id")
    inner = edges.join(ids.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").join(
        ids.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi"
    )
    return kept, inner


def readout(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """Max and mean of every feature per graph."""
    return nodes.groupBy("graph_id").agg(
        *[F.max(f).alias("max_" + f) for f in features], *[F.avg(f).alias("mean_" + f) for f in features]
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """`node`, `component` for both ends of every edge (u, v): the smallest node of the component.

    Alternating stars: a large star hangs each node's larger neighbours on its smallest one, a small star
    its smaller neighbours. The number of rounds grows with the logarithm of the longest path; each round
    is a table in the shared folder.
    """
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = written(ends, "edges")
    before = None
    while True:
        mark = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct(), "edges")
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
