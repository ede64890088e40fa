"""Batch processing that stops and goes on, and evaluators in one pass."""

import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from datasheaf.operators import batches as B
from datasheaf.operators import reducers as R

# The processor below travels to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Doubler(B.BatchProcessor):
    """Doubles `v`; holds every row back until the checkpoint. Fails at `bad` while the file `stop` is there."""

    def __init__(self, folder, bad=None):
        self.folder, self.bad = folder, bad

    def setup(self):
        return []

    def process(self, held, batch):
        if self.bad in set(batch["id"]) and (self.folder / "stop").exists():
            raise RuntimeError("stopped")
        with open(self.folder / "seen", "a") as f:
            f.writelines(f"{i}\n" for i in batch["id"])
        held.append(batch.assign(v=batch["v"] * 2))

    def on_checkpoint_start(self, held):
        return pd.concat(held) if held else None

    def on_finish(self, output):
        with open(self.folder / "finished", "a") as f:
            f.write(f"{output.count()}\n")


def test_a_stopped_run_goes_on_without_repeating(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") * 3).alias("v"))
    out = str(tmp_path / "out")
    (tmp_path / "stop").touch()
    with pytest.raises(Exception, match="stopped"):
        B.process_in_checkpoints(df, "id", Doubler(tmp_path, 60), "id long, v long", out, 4)
    before = B.progress(spark, out, 4)
    assert before["committed"] and len(before["committed"]) < 4 and not before["finished"]
    (tmp_path / "stop").unlink()
    (tmp_path / "seen").rename(tmp_path / "seen-before")
    got = B.process_in_checkpoints(df, "id", Doubler(tmp_path, 60), "id long, v long", out, 4)
    assert sorted(map(tuple, got.collect())) == [(i, 6 * i) for i in range(100)]
    again = {int(x) for x in (tmp_path / "seen").read_text().split()}
    assert 60 in again and len(again) < 100 and B.progress(spark, out, 4)["finished"]
    B.process_in_checkpoints(df, "id", Doubler(tmp_path), "id long, v long", out, 4)
    assert (tmp_path / "finished").read_text() == "100\n"
    assert {int(x) for x in (tmp_path / "seen").read_text().split()} == again


def test_nothing_to_process_still_finishes(spark, tmp_path):
    got = B.process_in_checkpoints(spark.range(0).withColumn("v", F.col("id")), "id", Doubler(tmp_path), "id long, v long", str(tmp_path / "o"), 2)
    assert got.count() == 0 and (tmp_path / "finished").read_text() == "0\n"


def test_evaluators_read_the_table_once(spark, tmp_path):
    spark.range(10).withColumn("x", F.col("id") * 2.0).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    two = {"a": {"mean": F.avg("x"), "n": F.count("x")}, "b": {"top": F.max("x")}}
    got = R.evaluate_all(df, two)
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {(r.metric, r.value) for r in got.collect()} == {("a/mean", 9.0), ("a/n", 10.0), ("b/top", 18.0)}
    mixed = R.evaluate_all(df, {**two, "c": lambda d: d.agg(F.min("x").alias("low"))})
    assert ("c/low", 0.0) in {(r.metric, r.value) for r in mixed.collect()}
    with pytest.raises(ValueError, match="reported by a and c"):
        R.evaluate_all(df, {**two, "c": {"mean": F.avg("x")}})
