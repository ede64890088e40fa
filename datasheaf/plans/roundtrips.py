"""Sources and sinks: a table written in a format and read back by the reader for it; extension points."""

import uuid

from pyspark.sql import functions as F

from datasheaf.operators import classification as M
from datasheaf.operators import packing as P
from datasheaf.operators import batches as H
from datasheaf.operators import reducers as R
from datasheaf.operators.positions import batch_id, global_index
from datasheaf.operators.splits import split_three_way
from datasheaf.plans.modelscores import logits
from datasheaf.plans.registry import query
from datasheaf.plans.sqltext import digest
from datasheaf.plans.vision import LINES, detections
from datasheaf.operators.detection import coco_result_rows
from datasheaf.session import checkpoint_dir
from datasheaf.sources import readers, writers


def _dir(t, name):
    """A new folder in the shared place of the session."""
    return f"{checkpoint_dir(t.spark)}/datasheaf-{name}-{uuid.uuid4().hex}"


@query("scan_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    path = _dir(t, "csv")
    t.customer.select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(path)
    return readers.read_csv(t.spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("scan_text_lines", """WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents WHERE lang IS NOT NULL),
  n AS (SELECT lang, value, row_number() OVER (PARTITION BY lang, doc_id // 100 ORDER BY doc_id, i) - 1 AS line FROM l)
  SELECT lang, value, count(*) AS n, min(line) AS first_line, sum(line)::BIGINT AS line_sum FROM n GROUP BY lang, value""")
def _(t):
    """A file of lines for each language and hundred documents, numbered as it is read."""
    path = _dir(t, "text")
    rows = t.documents.filter("lang IS NOT NULL").select(
        "doc_id", "lang", F.floor(F.col("doc_id") / 100).alias("block"), F.posexplode(F.split("text", "\n", -1)).alias("i", "value"))
    dealt = rows.repartition("lang", "block").sortWithinPartitions("lang", "block", "doc_id", "i")
    dealt.select("value", "lang", "block").write.partitionBy("lang", "block").text(path)
    lines = readers.read_text_lines(t.spark, path, ["lang"])
    return lines.groupBy("lang", "value").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"), F.sum("line").alias("line_sum"))


@query("scan_tsv_pairs", """SELECT (s_nationkey % 2)::VARCHAR AS label, s_suppkey::VARCHAR AS id1, s_nationkey::VARCHAR AS id2, s_name AS s1, '"' || s_name AS s2 FROM supplier""")
def _(t):
    path = _dir(t, "tsv")
    cols = [(F.col("s_nationkey") % 2).cast("string"), F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"),
            F.col("s_name"), F.concat(F.lit('"'), "s_name")]
    t.supplier.select(F.concat_ws("\t", *cols).alias("value")).write.text(path)
    return readers.read_tsv_pairs(t.spark, path)


@query("scan_image_listing", """WITH p AS (SELECT url AS path, CASE WHEN len(string_split(url, '/')) >= 2 THEN string_split(url, '/')[-2] END AS class FROM pages),
  f AS (SELECT class, row_number() OVER (ORDER BY min(path)) - 1 AS class_id FROM p GROUP BY class)
  SELECT path, class, class_id FROM p JOIN f USING (class)""")
def _(t):
    path = _dir(t, "listing")
    t.pages.select("url").write.text(path)
    return readers.read_image_listing(t.spark, path).select("path", "class", "class_id")


@query("scan_training_files", """SELECT 'train' AS split, doc_id, text FROM documents UNION ALL SELECT 'validation', item_id, text FROM benchmark""")
def _(t):
    base = _dir(t, "training")
    t.documents.select("doc_id", "text").write.json(f"{base}/train.json")
    t.benchmark.select(F.col("item_id").alias("doc_id"), "text").write.option("header", True).option(
        "escape", '"'
    ).option("quoteAll", True).csv(f"{base}/validation.csv")
    files = {"train": f"{base}/train.json", "validation": f"{base}/validation.csv"}
    return readers.read_training_files(t.spark, files, "doc_id long, text string").select("split", "doc_id", "text")


@query("write_splits", f"""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {digest('123', 'doc_id')}, doc_id) - 1 AS pos FROM documents),
  n AS (SELECT count(*) AS n, floor(count(*) * 0.8)::BIGINT AS tr FROM documents)
  SELECT CASE WHEN pos < tr THEN 'train' WHEN pos < n - ceil((n - tr) * 0.5) THEN 'valid' ELSE 'test' END AS split, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM p, n GROUP BY 1""")
def _(t):
    path = _dir(t, "splits")
    writers.write_splits(split_three_way(t.documents.select("doc_id", F.col("n_chars").alias("total_length")), "doc_id"), path)
    return t.spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("write_detections", f"""WITH {LINES} SELECT image_id, category_id, count(*) AS n, round(sum(x1 - x0), 6) AS w, round(sum(score), 3) AS score FROM p GROUP BY ALL""")
def _(t):
    path = _dir(t, "detections")
    writers.write_detections_json(coco_result_rows(detections(t)), path)
    back = readers.read_predictions(t.spark, path, "image_id long, category_id long, bbox array<double>, score double")
    return back.groupBy("image_id", "category_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("bbox", F.lit(2))), 6).alias("w"), F.round(F.sum("score"), 3).alias("score")
    )


@query("write_predictions", """WITH l AS (SELECT vec_id, embedding[1:10]::DOUBLE[] AS lg FROM embeddings)
  SELECT vec_id, (list_position(lg, list_max(lg)) - 1)::INTEGER AS pred, round(list_sum(lg), 6) AS logit_sum, round(lg[1] - lg[2], 6) AS odds FROM l""")
def _(t):
    rows = logits(t)
    odds = rows.select("vec_id", (F.get("logits", F.lit(0)) - F.get("logits", F.lit(1))).alias("odds"))
    paths = writers.write_predictions_json(rows.select("vec_id", "pred"), rows.select("vec_id", "logits"), _dir(t, "predictions"), odds)
    back = {
        name: readers.read_predictions(t.spark, paths[name], f"vec_id long, {column}")
        for name, column in (("predictions", "pred int"), ("nbest_predictions", "logits array<double>"), ("null_odds", "odds double"))
    }
    listed = back["nbest_predictions"].select("vec_id", F.round(F.aggregate("logits", F.lit(0.0), lambda a, x: a + x), 6).alias("logit_sum"))
    joined = back["predictions"].join(listed, "vec_id").join(back["null_odds"], "vec_id")
    return joined.withColumn("odds", F.round("odds", 6))


@query("write_sharded_batches", """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
  SELECT (pos // 512 % 4)::INTEGER AS shard, (pos // 512)::INTEGER AS batch, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM p GROUP BY ALL""")
def _(t):
    path = _dir(t, "batches")
    rows = global_index(t.orders.select("o_orderkey"), "o_orderkey")
    batch = batch_id(F.col("pos"), 512)
    writers.write_sharded_batches(rows, path, (batch % 4).cast("int"), batch.cast("int"))
    back = t.spark.read.schema("o_orderkey long, pos long, shard int, batch int").parquet(path)
    return back.groupBy("shard", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("report_metrics", """SELECT event_type AS grp, 'value' AS metric, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1
  UNION ALL SELECT event_type, 'k', count(*), round(sum(json_extract_string(props, '$.k')::DOUBLE), 4) FROM events GROUP BY 1""")
def _(t):
    path = _dir(t, "metrics")
    rows = t.events.select(
        F.col("event_type").alias("group"), F.col("event_id").alias("step"),
        F.map_concat(F.create_map(F.lit("value"), "value"), F.from_json("props", "map<string,double>")).alias("metrics"),
    )
    writers.report_metrics(rows, path)
    m = readers.read_experiment_metrics(t.spark, path)
    return m.groupBy(F.col("group").alias("grp"), "metric").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query("load_or_create", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(t):
    path = _dir(t, "dataset")

    def build():
        return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))

    readers.load_or_create(t.spark, path, build)
    return readers.load_or_create(t.spark, path, build)


@query("write_csv", "SELECT text AS input, role AS output, turn % 2 = 0 AS correct FROM conversations")
def _(t):
    path = _dir(t, "results")
    rows = t.conversations.select(F.col("text").alias("input"), F.col("role").alias("output"), (F.col("turn") % 2 == 0).alias("correct"))
    writers.write_csv(rows, path)
    return t.spark.read.schema("input string, output string, correct boolean").option("header", True).option(
        "escape", '"'
    ).option("multiLine", True).csv(path)


# Rows of one test file; a file of this format is one record.
FILE_ROWS = 500


def _one_file_each(rows, key, path):
    """A text file for every value of `key`, holding the column `value`."""
    rows.select(key, "value").write.partitionBy(key).text(path)


@query("scan_squad_json", """SELECT 'part ' || (c_custkey // 500)::VARCHAR AS title, c_name AS context, c_custkey::VARCHAR AS id, 'balance?' AS question,
  c_acctbal < 0 AS is_impossible, CASE WHEN c_acctbal >= 0 THEN c_name END AS answer, CASE WHEN c_acctbal >= 0 THEN 0 END AS answer_start FROM customer""")
def _(t):
    path = _dir(t, "squad")
    key = F.floor(F.col("c_custkey") / FILE_ROWS).alias("part")
    none = F.array().cast("array<struct<text:string,answer_start:int>>")
    answers = F.when(F.col("c_acctbal") >= 0, F.array(F.struct(F.col("c_name").alias("text"), F.lit(0).alias("answer_start")))).otherwise(none)
    qa = F.struct(F.col("c_custkey").cast("string").alias("id"), F.lit("balance?").alias("question"),
                  (F.col("c_acctbal") < 0).alias("is_impossible"), answers.alias("answers"))
    para = F.struct(F.col("c_name").alias("context"), F.array(qa).alias("qas"))
    doc = t.customer.groupBy(key).agg(F.collect_list(para).alias("paragraphs"))
    article = F.struct(F.concat(F.lit("part "), F.col("part").cast("string")).alias("title"), "paragraphs")
    _one_file_each(doc.withColumn("value", F.to_json(F.struct(F.array(article).alias("data")))), "part", path)
    return readers.read_squad_json(t.spark, path).select(
        "title", "context", "id", "question", "is_impossible", F.get("answers.text", F.lit(0)).alias("answer"),
        F.get("answers.answer_start", F.lit(0)).alias("answer_start"),
    )


@query("scan_coco", """SELECT s_suppkey AS image_id, s_name AS file_name, n_name AS category, (s_suppkey % 50 + 1) * 2.0::DOUBLE AS area
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(t):
    path = _dir(t, "coco")
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    side = (F.col("s_suppkey") % 50 + 1).cast("double")
    image = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("file_name"), F.lit(10).alias("height"), F.lit(60).alias("width"))
    note = F.struct(
        F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("image_id"), F.col("s_nationkey").alias("category_id"),
        F.array(F.lit(0.0), F.lit(0.0), side, F.lit(2.0)).alias("bbox"), (side * 2).alias("area"), F.lit(0).alias("iscrowd"))
    category = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    doc = rows.groupBy(F.floor(F.col("s_suppkey") / FILE_ROWS).alias("part")).agg(
        F.collect_list(image).alias("images"), F.collect_list(note).alias("annotations"), F.collect_set(category).alias("categories"))
    _one_file_each(doc.withColumn("value", F.to_json(F.struct("images", "annotations", "categories"))), "part", path)
    read = readers.read_coco(t.spark, path)
    names = read["categories"].distinct().select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    images = read["images"].select(F.col("id").alias("image_id"), "file_name")
    return read["annotations"].join(images, "image_id").join(names, "category_id").select("image_id", "file_name", "category", "area")


# Extension points

def _flag_counter():
    class Flags(R.PartialReducer):
        def init(self):
            return {"n": 0, "r": 0, "quantity": 0.0}

        def update(self, state, batch):
            state["n"] += len(batch)
            state["r"] += int((batch["l_returnflag"] == "R").sum())
            state["quantity"] += float(batch["l_quantity"].sum())
            return state

        def merge(self, a, b):
            return {k: a[k] + b[k] for k in a}

        def finish(self, state):
            return state

    return Flags()


@query("partial_reducer", "SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, sum(l_quantity) AS quantity FROM lineitem")
def _(t):
    return R.reduce_partials(
        t.lineitem.select("l_returnflag", "l_quantity"), _flag_counter(), "n long, r long, quantity double"
    )


@query("evaluators", """WITH l AS (SELECT label, (list_position(lg, list_max(lg)) - 1) AS pred FROM (SELECT label, embedding[1:10]::DOUBLE[] AS lg FROM embeddings))
  SELECT 'hits/accuracy' AS metric, round(avg((pred = label)::INTEGER), 6) AS value FROM l UNION ALL SELECT 'gap/mse', round(avg((pred - label) ** 2), 6) FROM l""")
def _(t):
    evaluators = {
        "hits": {"accuracy": M.accuracy("pred", "label")},
        "gap": {"mse": F.avg(F.pow(F.col("pred") - F.col("label"), F.lit(2)))},
    }
    return R.evaluate_all(logits(t), evaluators).withColumn("value", F.round("value", 6))


class _Scores(H.BatchProcessor):
    """Weighted sums of the vectors; half of the batches are held back until the checkpoint."""

    def setup(self):
        import numpy as np

        return {"w": 1.0 / np.arange(1, 65), "kept": []}

    def process(self, held, batch):
        import numpy as np

        x = np.stack(batch["embedding"].to_numpy()).astype("float64")
        scored = batch[["vec_id"]].assign(score=(x @ held["w"]).round(5))
        if batch["vec_id"].iloc[0] % 2:
            held["kept"].append(scored)
            return None
        return scored

    def on_checkpoint_start(self, held):
        import pandas as pd

        return pd.concat(held["kept"]) if held["kept"] else None


@query("batch_checkpoints", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x, i: x / i)), 5) AS score FROM embeddings")
def _(t):
    rows = t.embeddings.select("vec_id", "embedding")
    return H.process_in_checkpoints(rows, "vec_id", _Scores(), "vec_id long, score double", _dir(t, "checkpoints"), 4)


@query("collate_batches", """WITH p AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
  SELECT pos // 32 AS batch, count(*) AS n, string_agg(lang, ',' ORDER BY pos) AS langs FROM p GROUP BY 1""")
def _(t):
    rows = global_index(t.documents.select("doc_id", "lang"), "doc_id").withColumn("batch", batch_id(F.col("pos"), 32))
    c = P.collate(rows, "batch", "pos", "lang")
    return c.select(
        "batch", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda r: r["lang"]), ",").alias("langs")
    )


@query("wrap_reducer", "SELECT l_suppkey, round(median(l_quantity), 6) AS middle FROM lineitem GROUP BY l_suppkey")
def _(t):
    """A callable over all values of a group; a supplier has some hundred lines."""
    middle = R.wrap_reducer(lambda v: v.median())
    return t.lineitem.groupBy("l_suppkey").agg(F.round(middle("l_quantity"), 6).alias("middle"))


@query("map_batches", "SELECT o_orderkey, round(o_totalprice * 1.1, 4) AS gross FROM orders")
def _(t):
    def gross(b):
        return b[["o_orderkey"]].assign(gross=(b["o_totalprice"] * 1.1).round(4))

    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return R.map_batches(rows, gross, "o_orderkey long, gross double", remove_columns=["o_orderstatus"])
