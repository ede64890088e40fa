"""Sinks. Every write goes to a directory of part files; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, helper_columns: tuple[str, ...] = ("total_length",), mode: str = "errorifexists") -> None:
    """train / valid / test below one dataset name, helper columns dropped first."""
    df.drop(*helper_columns).write.mode(mode).partitionBy("split").parquet(path)


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] = ("input", "output", "correct"), mode: str = "errorifexists") -> None:
    """Result rows as CSV with a header; quotes are doubled and line breaks kept inside quotes."""
    df.select(*columns).write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_predictions_json(
    answers: DataFrame, nbest: DataFrame, path: str, null_odds: DataFrame | None = None, prefix: str | None = None,
    mode: str = "errorifexists",
) -> dict[str, str]:
    """Three outputs of JSON lines: predictions, n-best lists and null odds. Returns their paths."""
    tables = {"predictions": answers, "nbest_predictions": nbest}
    if null_odds is not None:
        tables["null_odds"] = null_odds
    out = {}
    for name, df in tables.items():
        out[name] = f"{path}/{prefix}_{name}" if prefix else f"{path}/{name}"
        df.write.mode(mode).json(out[name])
    return out


def write_detections_json(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Result rows (image_id, category_id, bbox, score) as JSON lines."""
    results.select(F.to_json(F.struct("image_id", "category_id", "bbox", "score")).alias("value")).write.mode(mode).text(path)


def write_sharded_batches(df: DataFrame, path: str, shard: Column, batch: Column, mode: str = "overwrite") -> None:
    """path/shard=s/batch=b. Run again for some batches, only their directories are replaced."""
    (
        df.withColumn("shard", shard).withColumn("batch", batch).write.mode(mode)
        .option("partitionOverwriteMode", "dynamic").partitionBy("shard", "batch").parquet(path)
    )


def report_metrics(df: DataFrame, path: str) -> None:
    """Appends metric rows (group, step, metrics map) below one directory per group."""
    df.write.mode("append").partitionBy("group").parquet(path)


def write_upsert(target: DataFrame, updates: DataFrame, key: str, arrival: str, path: str) -> None:
    """The merged table in a new directory; readers of the old one are not disturbed."""
    from datasheaf.operators.joins import upsert

    upsert(target, updates, key, arrival).write.mode("errorifexists").parquet(path)
