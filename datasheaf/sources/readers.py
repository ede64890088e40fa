"""Readers for the file formats datasets come in. Every reader is lazy and keeps its schema explicit."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from datasheaf.functions import text as T
from datasheaf.operators.positions import group_index
from datasheaf.sources.jsonfile import json_elements


def read_csv(spark: SparkSession, path: str, schema: S.StructType | str) -> DataFrame:
    """CSV with a schema given by hand; the header row is discarded."""
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", True)
        .option("mode", "FAILFAST").csv(path)
    )


def read_text_lines(spark: SparkSession, path: str, folders: Sequence[str] = ()) -> DataFrame:
    """`split` (file name without suffix), `line` (0-based in its file), `value`, for files of any size.

    `folders` are columns that folder names (`name=value`) below the path stand for.

    A file is read in blocks by many tasks. Lines are ordered by the block's start in the file and by
    the order in which its task read them, which the split plan of the scan fixes.
    """
    raw = spark.read.text(path).select(
        F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("split"),
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__read"), "value", *folders,
    )
    numbered = group_index(raw, "__file", ["__block", "__read"], "line")
    return numbered.select("split", "line", "value", *folders)


def read_lines_unordered(spark: SparkSession, path: str) -> DataFrame:
    """`split`, `value`: lines of files of any size, split across tasks, without an order."""
    return spark.read.text(path).select(
        F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("split"), "value"
    )


PAIR_FIELDS = ["label", "id1", "id2", "s1", "s2"]


def read_tsv_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Five tab-separated text fields under a header; no quoting, the row stripped at both ends."""
    cells = F.split(T.strip("value"), "\t", -1)
    rows = spark.read.text(path).select(*[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(PAIR_FIELDS)])
    return rows.filter(~F.col("id1").rlike(r"^\W*#1 ID$"))


_ANSWER = "struct<text:string,answer_start:int>"
_QA = f"array<struct<id:string,question:string,is_impossible:boolean,answers:array<{_ANSWER}>>>"
ARTICLE_SCHEMA = f"struct<title:string,paragraphs:array<struct<context:string,qas:{_QA}>>>"


def read_squad_json(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """One row per question: title, context, id, question, is_impossible, answers (parallel arrays).

    Reads v1.1 and v2.0: a missing flag is false, a question without answers keeps its row. A large file is
    read by many tasks, article by article.
    """
    doc = json_elements(spark, path, ["data"], range_bytes).select(F.from_json("element", ARTICLE_SCHEMA).alias("d"))
    para = doc.select("d.title", F.explode("d.paragraphs").alias("p"))
    qas = para.select("title", F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    answers = F.coalesce("q.answers", F.array().cast(f"array<{_ANSWER}>"))
    return qas.select(
        "title", "context", F.col("q.id").alias("id"), F.col("q.question").alias("question"),
        F.coalesce("q.is_impossible", F.lit(False)).alias("is_impossible"),
        F.struct(
            F.transform(answers, lambda a: a["text"]).alias("text"),
            F.transform(answers, lambda a: a["answer_start"]).alias("answer_start"),
        ).alias("answers"),
    )


COCO_SCHEMAS = {
    "images": "struct<id:long,file_name:string,height:int,width:int>",
    "annotations": (
        "struct<id:long,image_id:long,category_id:int,bbox:array<double>,area:double,iscrowd:int,"
        "keypoints:array<double>>"
    ),
    "categories": "struct<id:int,name:string>",
}


def read_coco(spark: SparkSession, path: str, range_bytes: int | None = None) -> dict[str, DataFrame]:
    """Tables images, annotations and categories of a detection file, which is read once, by many tasks."""
    found = json_elements(spark, path, list(COCO_SCHEMAS), range_bytes)

    def section(name: str) -> DataFrame:
        return found.filter(F.col("name") == name).select(F.from_json("element", COCO_SCHEMAS[name]).alias("r")).select("r.*")

    return {n: section(n) for n in COCO_SCHEMAS}


def read_image_listing(spark: SparkSession, path: str, order_by: str = "path") -> DataFrame:
    """`path`, `class` (parent directory), `class_id` (order of first appearance) of a path list."""
    from datasheaf.operators.corpus import first_seen_index

    rows = spark.read.text(path).select(T.strip("value").alias("path")).filter("path <> ''")
    listed = rows.withColumn("class", T.parent_name("path"))
    ids = first_seen_index(listed, "class", order_by).withColumnRenamed("id", "class_id")
    return listed.join(ids, "class")


def read_image_bytes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """`path`, `class`, `content`: image files; the bytes are read only when the column is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", True
    ).load(path).select("path", T.parent_name("path").alias("class"), "length", "content")


def read_training_files(spark: SparkSession, files: dict[str, str], schema: str | None = None) -> DataFrame:
    """Train and validation files (json lines or csv by suffix) in one frame with a `split` column."""
    out = None
    for split, path in files.items():
        kind = re.sub(r".*\.", "", path)
        reader = spark.read if schema is None else spark.read.schema(schema)
        if kind == "csv":
            part = reader.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        elif kind in ("json", "jsonl"):
            part = reader.json(path)
        else:
            raise ValueError(f"unknown file type {kind}")
        part = part.withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _located(spark: SparkSession, path: str):
    """Hadoop's path and file system of a name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """True when a finished write is at the path."""
    p, fs = _located(spark, path + "/_SUCCESS")
    return fs.exists(p)


def load_or_create(spark: SparkSession, path: str, builder: Callable[[], DataFrame], partition_by: Sequence[str] = ()) -> DataFrame:
    """The materialised dataset when its write finished, else build it, write it, read it back.

    It is written beside the path and renamed when it is whole, so builders at the same time do not disturb
    each other: the first one to finish is read by all. What an older write left half done at the path is replaced.
    """
    if not exists(spark, path):
        fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        builder().write.partitionBy(*partition_by).parquet(fresh)
        (new, fs), (old, _) = _located(spark, fresh), _located(spark, path)
        if not exists(spark, path):
            fs.delete(old, True)
            fs.rename(new, old)
        fs.delete(new, True)
    return spark.read.parquet(path)


def read_predictions(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """Prediction shards of all workers and batches below one directory."""
    return spark.read.schema(schema).format(kind).load(path)


def explode_metrics(df: DataFrame, metrics: str = "metrics") -> DataFrame:
    """One row per entry of the metric map: the other columns, `metric`, `value`."""
    keep = [c for c in df.columns if c != metrics]
    return df.select(*keep, F.explode(metrics).alias("metric", "value"))


def read_experiment_metrics(spark: SparkSession, path: str) -> DataFrame:
    return explode_metrics(spark.read.parquet(path))
