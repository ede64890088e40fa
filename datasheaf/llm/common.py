"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datasheaf.session import work_folder, written

# A table is sent to every executor only when it was counted and has at most this many rows.
SMALL_ROWS = 20_000


def sent_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of `rows` counted rows when that is few; otherwise leave the choice to Spark."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def spread_count(spark: SparkSession) -> int:
    """Partitions for an explicit deal, as many as the session uses for its shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """Rows kept from every fit: crc32 of the id's text is divisible by five. A missing id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drawn(ids: DataFrame, salt: str, rows: int) -> DataFrame:
    """At most `rows` distinct ids of `ids` (doc_id), the same on every run: those with the smallest md5."""
    key = F.md5(F.concat(F.lit(salt + ":"), F.col("doc_id").cast("string")))
    return ids.filter("doc_id is not null").select("doc_id").distinct().orderBy(key, "doc_id").limit(rows)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One text for each id of a bounded draw, joined where the documents are: the ids go to every task.

    Of rows with one id the least text is taken, so the result is no larger than the draw.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    others = [c for c in ids.columns if c != "doc_id"]
    return text.join(F.broadcast(ids), "doc_id").groupBy("doc_id", *others).agg(F.min("text").alias("text"))


def whole_row(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """All columns as one, so that their names cannot clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in (df.columns if columns is None else columns)]).alias("row")


def kept_by_text(docs: DataFrame, keep: Callable[[list[str]], Iterable[bool]]) -> DataFrame:
    """Rows of `docs` whose text (null: empty) `keep` accepts, columns unchanged."""
    framed = docs.select(whole_row(docs), F.coalesce("text", F.lit("")).alias("text"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = pa.array(list(keep(b["text"].to_pylist())), pa.bool_())
            yield pa.RecordBatch.from_arrays([b["row"].filter(mask)], ["row"])
    return framed.mapInArrow(run, framed.select("row").schema).select("row.*")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what is made of one slice at a time stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
