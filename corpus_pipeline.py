"""A training corpus in five stages: quality, toxicity, near copies, mixture, tokens.

Every stage takes all documents that its predecessor kept and, but for the last, returns the columns of
`documents`. `run` writes each stage's result to the shared folder before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datasheaf.llm import bpe, jaccard, mixing, quality, toxicity
from datasheaf.llm.common import written

TOKENIZER = "byte_bpe_50k.json"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3; a null text is scored as an empty one, repeated rows alike."""
    return quality.keep(docs, quality.fit(docs, labels(spark, sf_dir)))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; a null text is scored as an empty one, repeated rows alike."""
    return toxicity.keep(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; documents without words stay."""
    return jaccard.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, a row for each time one begins in it; documents without words are not part of a mix."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the token ids, and whether decoding them gives the text again.

    A null text is empty; repeated rows stay; an empty table gives none.
    """
    rows = docs.select("doc_id", "source", "text")
    both = bpe.encode_exactly(rows, public_tokenizers.path(TOKENIZER))
    return both.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES = [
    ("quality", good_quality), ("toxicity", not_toxic), ("near copies", one_of_each_group), ("mixture", mixture), ("tokens", tokens),
]
# The learned stages and the token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
