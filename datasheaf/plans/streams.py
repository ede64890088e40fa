"""Streams over the test tables, run to the end of the input and read back."""

import uuid

from pyspark.sql import functions as F

from datasheaf.functions import arrays as A
from datasheaf.operators import classification as M
from datasheaf.operators import embeddings as E
from datasheaf.plans.registry import query
from datasheaf.session import checkpoint_dir
from datasheaf.streaming import halving as H
from datasheaf.streaming import incremental as I


def _stream(t, table):
    """A table of one file or of a folder of part files: a pattern that matches its path alone may be either."""
    return I.file_stream(t.spark, f"{t.root}/{table}.parque[t]", getattr(t, table).schema)


def _dirs(t, name):
    base = f"{checkpoint_dir(t.spark)}/datasheaf-{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


LOGITS = """(SELECT vec_id, label, (list_position(lg, list_max(lg)) - 1)::INTEGER AS pred
  FROM (SELECT vec_id, label, embedding[1:10]::DOUBLE[] AS lg FROM embeddings))"""


def _predicted(t):
    return _stream(t, "embeddings").select(
        "vec_id", "label", A.argmax(A.as_double(F.slice("embedding", 1, 10))).cast("int").alias("pred")
    )


@query("stream_confusion", f"SELECT pred, label AS gt, count(*) AS n FROM {LOGITS} GROUP BY ALL")
def _(t):
    out, cp = _dirs(t, "confusion")
    I.run_complete(I.confusion_counts(_predicted(t), "pred", "label"), out, cp).awaitTermination()
    return I.newest(t.spark, out)


@query("stream_f1", f"""WITH c AS (SELECT DISTINCT label FROM embeddings), k AS (SELECT c.label, count(*) FILTER (pred = c.label AND l.label = c.label) AS tp,
    count(*) FILTER (pred = c.label AND l.label <> c.label) AS fp, count(*) FILTER (pred <> c.label AND l.label = c.label) AS fn FROM c, {LOGITS} l GROUP BY c.label)
  SELECT label, round(tp / nullif(tp + 0.5 * (fp + fn), 0), 6) AS f1 FROM k""")
def _(t):
    out, cp = _dirs(t, "f1")
    classes = t.embeddings.select("label").distinct()

    def finish(counts):
        return M.per_class_f1(counts, classes).select("label", F.round("f1", 6).alias("f1"))

    I.run_complete(I.confusion_counts(_predicted(t), "pred", "label"), out, cp, finish).awaitTermination()
    return I.newest(t.spark, out)


@query("stream_perplexity", """SELECT o_orderpriority AS grp, round(exp(sum(o_totalprice / 100000 * o_custkey) / sum(o_custkey)), 6) AS perplexity, count(*) AS batches
  FROM orders GROUP BY 1""")
def _(t):
    out, cp = _dirs(t, "perplexity")
    losses = _stream(t, "orders").select(
        F.col("o_orderpriority").alias("grp"), (F.col("o_totalprice") / 100000).alias("loss"), F.col("o_custkey").alias("n")
    )
    I.run_complete(I.loss_sums(losses, "loss", "n", ["grp"]), out, cp).awaitTermination()
    return I.perplexity_of(I.newest(t.spark, out)).select("grp", F.round("perplexity", 6).alias("perplexity"), "batches")


@query("stream_window_rollup", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
  FROM events GROUP BY ALL""")
def _(t):
    """The windows that the watermark closed, and those still open when the input ends: every event is counted."""
    out, cp = _dirs(t, "rollup")
    r = I.window_rollup(_stream(t, "events"), "ts", "event_type", "value", "1 hour", "1 hour")
    I.run_append(r, out, cp).awaitTermination()
    closed = t.spark.read.schema("start timestamp, event_type string, n long, total double").parquet(out)
    start = F.date_format("start", "yyyy-MM-dd HH:mm").alias("start")
    every = closed.unionByName(I.open_windows(t.spark, cp, "event_type"))
    return every.select(start, "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_inference", """SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x, i: x / i)), 5) AS score FROM embeddings""")
def _(t):
    import numpy as np

    out, cp = _dirs(t, "inference")

    def process(w, batch):
        x = np.stack(batch["embedding"].to_numpy()).astype("float64")
        return batch[["vec_id"]].assign(score=(x @ w).round(5))

    scored = E.batch_score(
        _stream(t, "embeddings").select("vec_id", "embedding"), lambda: 1.0 / np.arange(1, 65), process,
        "vec_id long, score double",
    )
    I.run_sharded_batches(scored, out, cp, F.col("vec_id") % 4).awaitTermination()
    return t.spark.read.parquet(out).select("vec_id", "score")


@query("stream_rungs")
def _(t):
    out, cp = _dirs(t, "rungs")
    r = _stream(t, "orders").select(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("search"), F.lit(0).alias("rung"),
        F.col("o_orderkey").alias("trial"), F.col("o_orderkey").alias("arrival"), F.col("o_totalprice").alias("metric"),
        F.lit(False).alias("exited_early"),
    )
    I.run_append(H.rung_stream(r, "search", 4), out, cp).awaitTermination()
    return t.spark.read.parquet(out)
