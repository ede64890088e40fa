"""Streams equal their batch results over several files, and go on after a stop."""

import pytest
from pyspark.sql import functions as F

from datasheaf.operators import embeddings as E
from datasheaf.operators import trials as V
from datasheaf.streaming import halving as H
from datasheaf.streaming import incremental as I
from test_trials import SCHEMA, results  # noqa: F401


def put(df, path, mode="append"):
    df.coalesce(1).write.mode(mode).parquet(path)


def test_confusion_grows_with_the_files(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    df = spark.range(60).select((F.col("id") % 3).alias("p"), (F.col("id") % 4).alias("y"))
    for part in range(3):
        put(df.filter(F.col("p") == part), src)
    counts = I.confusion_counts(I.file_stream(spark, src, df.schema, files_per_batch=1), "p", "y")
    I.run_complete(counts, out, cp).awaitTermination()
    put(df, src)
    counts = I.confusion_counts(I.file_stream(spark, src, df.schema, files_per_batch=1), "p", "y")
    I.run_complete(counts, out, cp).awaitTermination()
    want = {(r["p"], r["y"]): 2 * r["count"] for r in df.groupBy("p", "y").count().collect()}
    assert {(r["pred"], r["gt"]): r["n"] for r in I.newest(spark, out).collect()} == want


def test_inference_resumes_without_repeating(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    seen = []
    for start in (0, 40):
        put(spark.range(start, start + 40), src)
        rows = E.batch_score(
            I.file_stream(spark, src, "id long", files_per_batch=1), lambda: 3, lambda k, b: b.assign(y=b["id"] * k),
            "id long, y long",
        )
        I.run_sharded_batches(rows, out, cp, F.col("id") % 2).awaitTermination()
        back = spark.read.parquet(out)
        seen.append((back.count(), back.select("id").distinct().count(), back.agg(F.sum("y")).first()[0]))
    assert seen == [(40, 40, 3 * sum(range(40))), (80, 80, 3 * sum(range(80)))]


def test_late_rows_are_left_out(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    schema = "ts timestamp_ntz, k string, v double"

    def rows(*stamps):
        return spark.createDataFrame([(s, "a", 1.0) for s in stamps], "s string, k string, v double").select(
            F.col("s").cast("timestamp_ntz").alias("ts"), "k", "v"
        )

    for batch in (["2024-01-01 00:10:00", "2024-01-01 05:00:00"], ["2024-01-01 00:20:00", "2024-01-01 09:00:00"]):
        put(rows(*batch), src)
        r = I.window_rollup(I.file_stream(spark, src, schema, files_per_batch=1), "ts", "k", "v", "1 hour", "1 hour")
        I.run_append(r, out, cp).awaitTermination()
    got = {str(r["start"])[11:16]: r["n"] for r in spark.read.parquet(out).collect()}
    assert got == {"00:00": 1, "05:00": 1}


def test_rungs_stream_equals_replay(spark, tmp_path, results):  # noqa: F811
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    ordered = sorted(results, key=lambda r: r[2])
    parts = [ordered[:70], ordered[70:150], ordered[150:]]
    for p in parts:
        put(spark.createDataFrame(p, SCHEMA), src)
        s = H.rung_stream(I.file_stream(spark, src, SCHEMA, files_per_batch=1), "search", 3)
        I.run_append(s, out, cp).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("search", "arrival", "rung", "promoted").collect())
    batch = V.rung_async(spark.createDataFrame(results, SCHEMA), "search", 3)
    assert got == sorted(tuple(r) for r in batch.select("search", "arrival", "rung", "promoted").collect())


def test_perplexity(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 4.0, 1), ("b", 1000.0, 1)], "g string, x double, n int")
    put(df, src)
    I.run_complete(I.loss_sums(I.file_stream(spark, src, df.schema), "x", "n", ["g"]), out, cp).awaitTermination()
    got = {r["g"]: r["perplexity"] for r in I.perplexity_of(I.newest(spark, out)).collect()}
    assert got["a"] == pytest.approx(7.38905609893065) and got["b"] == 100000.0


@pytest.mark.parametrize("name", ["stream_confusion", "stream_f1", "stream_inference"])
def test_tables_in_folders_stream_like_single_files(spark, tmp_path, name):
    from datasheaf.plans import QUERIES

    schema = "vec_id long, embedding array<float>, label long"
    rows = [(i, [float((i * 7 + j * 3) % 11) for j in range(64)], i % 10) for i in range(60)]
    df = spark.createDataFrame(rows, schema)
    df.repartition(3).write.parquet(f"{tmp_path}/folder/embeddings.parquet")
    put(df, f"{tmp_path}/written")
    (tmp_path / "file").mkdir()
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "file" / "embeddings.parquet")
    folder, single = (sorted(map(tuple, QUERIES[name](spark, f"{tmp_path}/{kind}").collect())) for kind in ("folder", "file"))
    assert folder and folder == single
