"""Column resolution, label indices and remapping."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasheaf.operators.positions import global_index

# The sentence columns of each text-classification task.
TASK_COLUMNS = {
    "cola": ("sentence", None), "mnli": ("premise", "hypothesis"), "mrpc": ("sentence1", "sentence2"),
    "qnli": ("question", "sentence"), "qqp": ("question1", "question2"), "rte": ("sentence1", "sentence2"),
    "sst2": ("sentence", None), "stsb": ("sentence1", "sentence2"), "wnli": ("sentence1", "sentence2"),
}


def resolve_column(df: DataFrame, wanted: str, fallback_pos: int) -> str:
    """The named column when present, else the one at the position."""
    return wanted if wanted in df.columns else df.columns[fallback_pos]


def resolve_sentences(df: DataFrame, task: str | None = None) -> tuple[str, str | None]:
    """Sentence columns by task, else by name, else the first two that are not the label."""
    if task is not None:
        return TASK_COLUMNS[task]
    other = [c for c in df.columns if c != "label"]
    if "sentence1" in other and "sentence2" in other:
        return "sentence1", "sentence2"
    return (other[0], other[1]) if len(other) >= 2 else (other[0], None)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that later filters and projections must not compute again.

    Catalyst copies a plain expression into every filter that is pushed below it; it does not look
    through a generator, and one over a single element keeps the rows as they are.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def keep_only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    return df.select(*columns)


# Old proposal column names and their current ones.
LEGACY_PROPOSAL_NAMES = {"indexes": "ids", "scores": "objectness_logits"}


def rename_legacy_keys(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed(names or LEGACY_PROPOSAL_NAMES)


def label_names(df: DataFrame, col: str) -> DataFrame:
    """`col`, `id`: sorted distinct labels numbered from 0."""
    return global_index(df.select(col).filter(F.col(col).isNotNull()).distinct(), col, "id")


def label_index(df: DataFrame, col: str, out: str = "label_id") -> DataFrame:
    """Adds the number of the row's label."""
    return df.join(label_names(df, col).withColumnRenamed("id", out), col, "left")


def remap_labels(names: DataFrame, model: DataFrame) -> DataFrame:
    """`name`, `id`: the model's ids when both tables hold the same names (in any case), else ours.

    Both inputs are (name, id). The set test is one aggregate over a full join of the name tables.
    """
    a = names.select(F.lower("name").alias("k"), "name", F.col("id").alias("own"))
    b = model.select(F.lower("name").alias("k"), F.col("id").alias("theirs"))
    j = a.join(b, "k", "full_outer")
    differ = j.filter(F.col("own").isNull() | F.col("theirs").isNull()).agg(F.count(F.lit(1)).alias("n"))
    out = a.join(b, "k", "left").withColumn("__n", differ.scalar())
    return out.select("name", F.when(F.col("__n") == 0, F.col("theirs")).otherwise(F.col("own")).alias("id"))


def add_dataset_index(frames: Sequence[DataFrame], out: str = "dataset_index") -> DataFrame:
    """All rows, tagged with the ordinal of their dataset. Inputs need equal schemas and rows."""
    if not frames:
        raise ValueError("nothing to concatenate")
    shape = [(f.name, f.dataType) for f in frames[0].schema]
    tagged = None
    for i, df in enumerate(frames):
        if [(f.name, f.dataType) for f in df.schema] != shape:
            raise ValueError(f"schema of dataset {i} differs")
        if df.isEmpty():
            raise ValueError(f"dataset {i} is empty")
        part = df.withColumn(out, F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged


def concatenate(frames: Sequence[DataFrame]) -> DataFrame:
    return add_dataset_index(frames, "__ds").drop("__ds")


def flatten_metrics(df: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """`metric` (group/name) and `value` for every metric column."""
    long = df.select(group, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [group], list(metrics), "name", "value"
    )
    return long.select(F.concat_ws("/", F.col(group).cast("string"), "name").alias("metric"), "value")


def expect_count(df: DataFrame, n: int) -> int:
    """Counts the rows and warns when they are not the configured number."""
    got = df.count()
    if got != n:
        warnings.warn(f"expected {n} rows, found {got}", stacklevel=2)
    return got


PREFERENCE_TRIPLET = "prompt,chosen,rejected"
PREFERENCE_CHAT = "chosen,rejected"


def preference_format(df: DataFrame) -> str:
    """Triplet when prompt, chosen and rejected are present, chat when the two are message lists."""
    kinds = {f.name: f.dataType for f in df.schema}
    if "chosen" not in kinds or "rejected" not in kinds:
        raise ValueError("a preference dataset needs the columns chosen and rejected")
    if "prompt" in kinds:
        return PREFERENCE_TRIPLET
    for c in ("chosen", "rejected"):
        t = kinds[c]
        fields = set(getattr(getattr(t, "elementType", None), "names", []) or [])
        if t.typeName() != "array" or not {"role", "content"} <= fields:
            raise ValueError(f"column {c} is not a list of messages")
    return PREFERENCE_CHAT
