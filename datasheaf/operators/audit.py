"""Token audit of formatted records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasheaf.functions import text as T


def token_audit(df: DataFrame, by: Sequence[str], text: str, marker: str, max_tokens: int) -> DataFrame:
    """Per group: rows, words in total and before the response marker, rows whose first `max_tokens`
    words (joined by blanks) lack the marker, and rows that are cut at `max_tokens`."""
    kept = F.array_join(F.slice(T.words(text), 1, max_tokens), " ")
    m = df.select(
        *by, T.word_count(text).alias("n"), T.word_count(T.before_marker(text, marker)).alias("b"),
        F.contains(kept, F.lit(marker)).alias("has"),
    )
    return m.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__rows"), F.sum("n").alias("tokens"), F.sum("b").alias("before_tokens"),
        F.count_if(~F.col("has")).alias("without_marker"),
        F.count_if(F.col("n") > max_tokens).alias("cut"),
    ).withColumnRenamed("__rows", "n")
