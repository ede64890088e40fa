"""Structured Streaming forms of the reductions: metrics kept as counts and sums per batch.

Every query here is a file-to-file stream with a checkpoint: stopped and started again, it goes on
after the last finished batch. The event-time window and its watermark are additions of this
library; the batch operators know steps only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from datasheaf.operators.language import bounded_exp


def file_stream(
    spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_batch: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    r = spark.readStream.schema(schema).format(kind)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(path)


def confusion_counts(stream: DataFrame, pred: str, label: str) -> DataFrame:
    """Running counts of (pred, gt); the state holds one number per pair of classes."""
    return stream.groupBy(F.col(pred).alias("pred"), F.col(label).alias("gt")).agg(F.count(F.lit(1)).alias("n"))


def loss_sums(stream: DataFrame, loss: str, n: str, by: Sequence[str] = ()) -> DataFrame:
    """Running sums from which mean loss and perplexity follow."""
    return stream.groupBy(*by).agg(
        F.sum(F.col(loss) * F.col(n)).alias("loss_sum"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("batches")
    )


def perplexity_of(sums: DataFrame) -> DataFrame:
    mean = F.col("loss_sum") / F.col("n")
    return sums.withColumn("perplexity", bounded_exp(mean))


def window_rollup(
    stream: DataFrame, ts: str, series: str, value: str, width: str, late: str
) -> DataFrame:
    """Count and sum per series and event-time window; rows later than `late` are left out."""
    return (
        stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
        .groupBy(F.window("__ts", width).alias("w"), series)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("start"), series, "n", "total")
    )


def open_windows(spark: SparkSession, checkpoint: str, series: str) -> DataFrame:
    """Windows of `window_rollup` that the watermark has not closed: what is left in the state of a finished query.

    With the windows written they are all windows of the input. The state is read as a table, by partition.
    """
    state = spark.read.format("statestore").load(checkpoint)
    n, total = state.schema["value"].dataType.names
    return state.select(
        F.col("key.window.start").alias("start"), F.col(f"key.{series}").alias(series),
        F.col(f"value.{n}").alias("n"), F.col(f"value.{total}").alias("total"),
    )


def run_complete(counts: DataFrame, out: str, checkpoint: str, finish: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Writes the whole (small) result table after every batch; the newest directory is the result.

    Each batch writes its own directory, so a repeated batch overwrites itself only.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        finish(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )


def newest(spark: SparkSession, out: str) -> DataFrame:
    """The table of the last batch of `run_complete`."""
    all_batches = spark.read.parquet(out)
    last = all_batches.agg(F.max("batch")).first()[0]
    return all_batches.filter(F.col("batch") == last).drop("batch")


def run_append(rows: DataFrame, out: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Appends finished rows; the file sink's log makes a restart leave no row out or twice."""
    return (
        rows.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).partitionBy(*partition_by).trigger(availableNow=True).start()
    )


def run_sharded_batches(rows: DataFrame, out: str, checkpoint: str, shard: Column) -> StreamingQuery:
    """One directory per batch and shard: out/batch=b/shard=s. A batch that is run again after a
    failure replaces its own files."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("shard", shard).write.mode("overwrite").partitionBy("shard").parquet(f"{out}/batch={batch_id}")

    return (
        rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(write).start()
    )
