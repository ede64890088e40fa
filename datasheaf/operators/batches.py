"""Batch processing with committed progress: a run that stops goes on where it was, without repeating work."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasheaf.operators.positions import placed_in_order


class BatchProcessor:
    """What a user of `process_in_checkpoints` gives; every hook but `process` may be left as it is."""

    def setup(self) -> object:
        """Once in each task: what the other hooks get as `held`, such as a loaded model."""

    def process(self, held: object, batch: pd.DataFrame) -> pd.DataFrame | None:
        """Rows of one Arrow batch, or None where the processor keeps them in `held` for now."""
        raise NotImplementedError

    def on_checkpoint_start(self, held: object) -> pd.DataFrame | None:
        """Once at the end of each task, before its rows are committed: the rows still held back."""

    def on_finish(self, output: DataFrame) -> None:
        """Once on the driver, with all rows, after the last checkpoint."""


def process_in_checkpoints(
    df: DataFrame, order_by: str | Sequence[str], processor: BatchProcessor, schema: str, out: str, checkpoints: int = 10,
) -> DataFrame:
    """The processor's rows for all of `df`, written to `out` in `checkpoints` stretches of the order.

    The rows are dealt to the checkpoints by ranges of `order_by` that are written down before the first one,
    so a later run finds the same. A checkpoint is one job; the committer's success mark of its folder is the
    progress. What has the mark is not processed again; a stretch that died half way is written anew. `on_finish`
    is called until it has returned once. An empty table gives an empty result and still finishes.
    """
    spark = df.sparkSession
    dealt = f"{out}/input"
    if not done(spark, dealt):
        placed_in_order(df, order_by, checkpoints).write.mode("overwrite").partitionBy("__stretch").parquet(dealt)
    kept = T.StructType([*df.schema.fields, T.StructField("__stretch", T.IntegerType())])
    rows = spark.read.schema(kept).parquet(dealt)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = processor.setup()
        for b in batches:
            got = processor.process(held, b)
            if got is not None:
                yield got
        rest = processor.on_checkpoint_start(held)
        if rest is not None:
            yield rest

    for k in range(checkpoints):
        folder = f"{out}/rows/checkpoint={k}"
        if not done(spark, folder):
            here = rows.filter(F.col("__stretch") == k).drop("__stretch")
            here.mapInPandas(run, schema).write.mode("overwrite").parquet(folder)
    result = spark.read.schema(f"{schema}, checkpoint int").parquet(f"{out}/rows").drop("checkpoint")
    if not done(spark, f"{out}/finished"):
        processor.on_finish(result)
        spark.range(1).write.mode("overwrite").parquet(f"{out}/finished")
    return result


def done(spark: SparkSession, folder: str) -> bool:
    """True when a write to the folder was committed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def progress(spark: SparkSession, out: str, checkpoints: int = 10) -> dict:
    """Checkpoints that are committed, and whether the run has finished."""
    return {"committed": [k for k in range(checkpoints) if done(spark, f"{out}/rows/checkpoint={k}")], "finished": done(spark, f"{out}/finished")}
