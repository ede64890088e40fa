"""Every file format by a round trip on generated files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from datasheaf.sources import readers as R
from datasheaf.sources import writers as W


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_with_given_names(spark, tmp_path):
    p = put(tmp_path / "iris.csv", "120,4,setosa,versicolor,virginica\n6.4,2.8,5.6,2.2,2\n5.0,2.3,3.3,1.0,1\n")
    df = R.read_csv(spark, p, "SepalLength double, SepalWidth double, PetalLength double, PetalWidth double, Species int")
    assert [tuple(r) for r in df.collect()] == [(6.4, 2.8, 5.6, 2.2, 2), (5.0, 2.3, 3.3, 1.0, 1)]


def test_text_lines(spark, tmp_path):
    put(tmp_path / "train.txt", "a b\r\n\n é c\n")
    put(tmp_path / "valid.txt", "x")
    got = [tuple(r) for r in R.read_text_lines(spark, str(tmp_path)).orderBy("split", "line").collect()]
    assert got == [("train", 0, "a b"), ("train", 1, ""), ("train", 2, " é c"), ("valid", 0, "x")]
    assert R.read_lines_unordered(spark, str(tmp_path)).count() == 4


def test_long_files_are_numbered_across_blocks(spark, tmp_path, monkeypatch):
    from datasheaf.operators import positions

    put(tmp_path / "long.txt", "\n".join(str(i) for i in range(5000)))
    monkeypatch.setattr(positions, "ROWS_PER_RANGE", 300)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = R.read_text_lines(spark, str(tmp_path))
        assert df.count() == 5000 and df.filter("line <> cast(value AS long)").isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tsv_pairs(spark, tmp_path):
    p = put(tmp_path / "p.txt", '﻿Quality\t#1 ID\t#2 ID\t#1 String\t#2 String\n1\t70\t71\tHe said "x\tShe "y"  \n0\t72\t73\ta\tb\n')
    got = [tuple(r) for r in R.read_tsv_pairs(spark, p).orderBy("id1").collect()]
    assert got == [("1", "70", "71", 'He said "x', 'She "y"'), ("0", "72", "73", "a", "b")]


def test_squad(spark, tmp_path):
    v2 = {"version": "v2.0", "data": [{"title": "T", "paragraphs": [{"context": "ab cd", "qas": [
        {"id": "1", "question": "q?", "is_impossible": False, "answers": [{"text": "ab", "answer_start": 0}, {"text": "cd", "answer_start": 3}]},
        {"id": "2", "question": "r?", "is_impossible": True, "answers": [], "plausible_answers": []}]}]}]}
    v1 = {"version": "1.1", "data": [{"title": "U", "paragraphs": [{"context": "c", "qas": [{"id": "3", "question": "s?", "answers": [{"text": "c", "answer_start": 0}]}]}]}]}
    put(tmp_path / "a.json", json.dumps(v2, indent=1))
    put(tmp_path / "b.json", json.dumps(v1))
    rows = {r["id"]: r for r in R.read_squad_json(spark, str(tmp_path)).collect()}
    assert rows["1"]["answers"]["text"] == ["ab", "cd"] and rows["1"]["answers"]["answer_start"] == [0, 3]
    assert rows["2"]["is_impossible"] and rows["2"]["answers"]["text"] == []
    assert rows["3"]["is_impossible"] is False and rows["3"]["context"] == "c"


def test_coco(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "height": 4, "width": 5}, {"id": 2, "file_name": "b.jpg", "height": 4, "width": 5}],
        "annotations": [{"id": 9, "image_id": 1, "category_id": 3, "bbox": [0, 0, 2, 2], "area": 4.0, "iscrowd": 0, "segmentation": [[1, 2]]}],
        "categories": [{"id": 3, "name": "cat"}],
    }
    t = R.read_coco(spark, put(tmp_path / "c.json", json.dumps(doc)))
    assert t["images"].count() == 2 and t["categories"].first()["name"] == "cat"
    assert t["annotations"].first()["bbox"] == [0.0, 0.0, 2.0, 2.0]


def test_image_listing_and_bytes(spark, tmp_path):
    p = put(tmp_path / "list.txt", "/d/dog/1.jpg\n/d/cat/2.jpg\n\n/d/dog/3.jpg\n")
    got = {r["path"]: (r["class"], r["class_id"]) for r in R.read_image_listing(spark, p).collect()}
    assert got == {"/d/dog/1.jpg": ("dog", 1), "/d/dog/3.jpg": ("dog", 1), "/d/cat/2.jpg": ("cat", 0)}
    d = tmp_path / "img" / "cat"
    d.mkdir(parents=True)
    (d / "1.png").write_bytes(b"\x01\x02")
    r = R.read_image_bytes(spark, str(tmp_path / "img"), "*.png").first()
    assert r["class"] == "cat" and bytes(r["content"]) == b"\x01\x02"


def test_training_files(spark, tmp_path):
    a = put(tmp_path / "t.json", '{"sentence1": "x", "label": 1}\n')
    b = put(tmp_path / "v.csv", 'sentence1,label\n"y, ""z""",0\n')
    rows = {r["split"]: (r["sentence1"], r["label"]) for r in R.read_training_files(spark, {"train": a, "validation": b}, "sentence1 string, label int").collect()}
    assert rows == {"train": ("x", 1), "validation": ('y, "z"', 0)}
    with pytest.raises(ValueError):
        R.read_training_files(spark, {"train": "x.bin"})


def test_load_or_create_builds_once_and_repairs(spark, tmp_path):
    path, calls = str(tmp_path / "ds"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert R.load_or_create(spark, path, build).count() == 3
    assert R.load_or_create(spark, path, build).count() == 3 and len(calls) == 1
    (tmp_path / "ds" / "_SUCCESS").rename(tmp_path / "ds" / "_half")
    assert R.load_or_create(spark, path, build).count() == 3 and len(calls) == 2


def test_splits_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", 3), ("test", "b", 4)], "split string, t string, total_length int")
    W.write_splits(df, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(back.columns) == ["split", "t"] and back.filter("split = 'test'").first()["t"] == "b"
    res = spark.createDataFrame([("i", 'o, "q"\nnext', True)], "input string, output string, correct boolean")
    W.write_csv(res, str(tmp_path / "c"))
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "c")).first()
    assert tuple(r) == ("i", 'o, "q"\nnext', "true")


def test_prediction_outputs(spark, tmp_path):
    ans = spark.createDataFrame([("1", "x")], "id string, answer string")
    odds = spark.createDataFrame([("1", -2.5)], "id string, score double")
    paths = W.write_predictions_json(ans, ans, str(tmp_path / "o"), odds, prefix="eval")
    assert set(paths) == {"predictions", "nbest_predictions", "null_odds"} and paths["null_odds"].endswith("eval_null_odds")
    assert R.read_predictions(spark, paths["null_odds"], "id string, score double").first()["score"] == -2.5
    det = spark.createDataFrame([(1, 2, [0.0, 1.0, 2.0, 3.0], 0.5)], "image_id long, category_id int, bbox array<double>, score double")
    W.write_detections_json(det, str(tmp_path / "d"))
    assert json.loads(spark.read.text(str(tmp_path / "d")).first()[0]) == {"image_id": 1, "category_id": 2, "bbox": [0.0, 1.0, 2.0, 3.0], "score": 0.5}


def test_sharded_batches_resume(spark, tmp_path):
    path = str(tmp_path / "b")
    df = spark.range(100)
    W.write_sharded_batches(df, path, F.col("id") % 2, F.floor(F.col("id") / 50))
    # one batch again: its files are replaced, the others stay
    W.write_sharded_batches(df.filter("id < 50"), path, F.col("id") % 2, F.floor(F.col("id") / 50))
    back = spark.read.parquet(path)
    assert back.count() == 100 and back.select("id").distinct().count() == 100
    assert back.filter("shard = 1 AND batch = 0").count() == 25


def test_metric_rows(spark, tmp_path):
    path = str(tmp_path / "m")
    for step in (1, 2):
        rows = [("train", step, {"loss": 1.0 / step, "acc": 0.5}), ("val", step, {"loss": 2.0})]
        W.report_metrics(spark.createDataFrame(rows, "`group` string, step int, metrics map<string,double>"), path)
    got = {(r["group"], r["step"], r["metric"]): r["value"] for r in R.read_experiment_metrics(spark, path).collect()}
    assert len(got) == 6 and got["train", 2, "loss"] == 0.5


def test_upsert(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    u = spark.createDataFrame([(2, "c", 1), (2, "d", 5), (3, "e", 1)], "id int, v string, at int")
    W.write_upsert(t, u, "id", "at", str(tmp_path / "u"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {(1, "a"), (2, "d"), (3, "e")}


def nasty_file(path, seed=3):
    rnd = random.Random(seed)
    bad = ["plain", "br{ace", '"quo"te', "back\\", '\\\\"', "[]}{", "é日🙂\n", '\\\\\\"{']
    doc = {
        "info": {"a": [1, {"x": 2}], "d": 'he{"y'}, "licenses": [],
        "images": [{"id": i, "file_name": rnd.choice(bad) * rnd.randint(1, 4), "height": 3, "width": i} for i in range(60)],
        "annotations": [{"id": i, "image_id": i % 60, "category_id": 1, "bbox": [1.0, 2, 3, 4], "area": 1.5, "iscrowd": 0,
                         "note": {"deep": [rnd.choice(bad), [{}]]}} for i in range(150)],
        "categories": [{"id": 1, "name": 'c"{at'}, {"id": 2, "name": ""}],
    }
    path.write_text(json.dumps(doc, ensure_ascii=False, indent=seed % 2 or None), encoding="utf-8")
    return doc


@pytest.mark.parametrize("seed", [2, 3])
@pytest.mark.parametrize("ranges", [1, 16, 150])
def test_one_json_file_in_many_ranges(spark, tmp_path, seed, ranges):
    path = tmp_path / "notes.json"
    doc = nasty_file(path, seed)
    size = -(-path.stat().st_size // ranges)
    t = R.read_coco(spark, str(path), size)
    assert sorted((r.id, r.file_name, r.width) for r in t["images"].collect()) == sorted((x["id"], x["file_name"], x["width"]) for x in doc["images"])
    assert sorted((r.id, r.image_id, r.bbox, r.keypoints) for r in t["annotations"].collect()) == [(x["id"], x["image_id"], x["bbox"], None) for x in doc["annotations"]]
    assert sorted((r.id, r.name) for r in t["categories"].collect()) == [(1, 'c"{at'), (2, "")]


def test_squad_file_in_many_ranges(spark, tmp_path):
    qa = lambda i: {"id": str(i), "question": 'w"h{y?', "answers": [{"text": "t", "answer_start": i}] * (i % 3)}
    doc = {"version": "v2.0", "data": [{"title": f"t{k}", "paragraphs": [{"context": "c]" * k, "qas": [qa(10 * k + i) for i in range(k % 4)]}]}
                                       for k in range(40)]}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "squad.json").write_text(json.dumps(doc))
    (tmp_path / "a" / "none.json").write_text(json.dumps({"data": []}))
    wide, narrow = ([tuple(r) for r in R.read_squad_json(spark, str(tmp_path / "a"), n).collect()] for n in (None, 100))
    assert sorted(wide) == sorted(narrow) and len(wide) == sum(k % 4 for k in range(40))
    assert {r[2] for r in wide} == {str(10 * k + i) for k in range(40) for i in range(k % 4)}
    (tmp_path / "empty").mkdir()
    assert R.read_squad_json(spark, str(tmp_path / "empty")).count() == 0


def test_json_file_cut_short_is_refused(spark, tmp_path):
    (tmp_path / "cut.json").write_text('{"images": [{"id": 1}, {"id": 2')
    with pytest.raises(Exception, match="ends inside"):
        R.read_coco(spark, str(tmp_path / "cut.json"))
