"""Fixed-length packing, sliding windows, padding and length-aware batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datasheaf.functions.arrays import attention_mask, pad_truncate
from datasheaf.operators.positions import batch_id, global_index, group_index


def pack_fixed(
    df: DataFrame, tokens: str, order_by: str | Sequence[str], length: int, block_rows: int = 1000
) -> DataFrame:
    """Concatenate the token arrays of each block of rows and cut pieces of `length`.

    The remainder of every block is dropped. Each row contributes one slice per piece it touches,
    so token arrays are cut, never exploded. A block is `block_rows` rows by definition.
    """
    rows = global_index(df, order_by, "__pos").withColumn("block", batch_id(F.col("__pos"), block_rows))
    w = Window.partitionBy("block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.size(tokens)).over(w), F.lit(0))
    placed = (
        rows.withColumn("__n", F.size(tokens))
        .withColumn("__start", start)
        .filter("__n > 0")
        .withColumn(
            "piece",
            F.explode(F.expr(
                f"sequence(__start div {length}, (__start + __n - 1) div {length})"
            )),
        )
        .withColumn("__lo", F.greatest(F.col("__start"), F.col("piece") * length))
        .withColumn("__hi", F.least(F.expr("__start + __n"), (F.col("piece") + 1) * length))
    )
    part = F.expr(
        f"slice(`{tokens}`, cast(__lo - __start + 1 as int), cast(__hi - __lo as int))"
    )
    return (
        placed.select("block", "piece", "__lo", part.alias("part"))
        .groupBy("block", "piece")
        .agg(
            F.flatten(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("__lo", "part"))), lambda s: s["part"]
                )
            ).alias("tokens")
        )
        .filter(F.size("tokens") == length)
    )


def sliding_windows(
    df: DataFrame, tokens: str, question_len: Column, max_len: int, stride: int, specials: int = 3
) -> DataFrame:
    """Overflow windows of a long context behind a fixed question.

    A window holds max_len - question - specials context tokens and overlaps the next one by
    `stride`; the last window is the first that reaches the end.
    """
    room = F.lit(max_len - specials) - question_len
    step = room - stride
    n = F.size(tokens)
    last = F.when(n <= room, F.lit(0)).otherwise(F.ceil((n - room) / step))
    return (
        df.withColumn("__room", room).withColumn("__step", step)
        .withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
        .withColumn("start", F.col("window") * F.col("__step"))
        .withColumn(
            "window_tokens",
            F.expr(f"slice(`{tokens}`, cast(start + 1 as int), cast(__room as int))"),
        )
        .drop("__room", "__step")
    )


def padded(df: DataFrame, tokens: str, length: int | Column, pad: Column, side: str = "right") -> DataFrame:
    """Adds `input_ids` of exactly `length` and its `attention_mask`."""
    return df.withColumn("input_ids", pad_truncate(tokens, length, pad, side)).withColumn(
        "attention_mask", attention_mask(tokens, length, side)
    )


def batch_width(df: DataFrame, tokens: str, batch: str, multiple_of: int = 1) -> DataFrame:
    """Adds `width`: the longest row of the batch, rounded up. A batch is small by definition."""
    longest = F.max(F.size(tokens)).over(Window.partitionBy(batch))
    return df.withColumn("width", (F.ceil(longest / multiple_of) * multiple_of).cast("long"))


def length_batches(df: DataFrame, tokens: str, ties: Sequence[str], size: int) -> DataFrame:
    """Batches of consecutive rows in length order, each padded to its own longest row."""
    sized = df.withColumn("__len", F.size(tokens))
    ordered = global_index(sized, ["__len", *ties], "__pos")
    batched = ordered.withColumn("batch", batch_id(F.col("__pos"), size)).drop("__pos", "__len")
    return batch_width(batched, tokens, "batch")


def aspect_batches(
    df: DataFrame, width: Column, height: Column, order_by: Sequence[str], size: int
) -> DataFrame:
    """Batches inside two shape buckets (0 when wider than high); short batches are not emitted."""
    bucketed = df.withColumn("bucket", F.when(width > height, 0).otherwise(1))
    placed = group_index(bucketed, "bucket", order_by, "__pos").withColumn(
        "batch", batch_id(F.col("__pos"), size)
    )
    totals = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("__n"))
    return (
        placed.join(totals, "bucket")
        .filter(F.col("batch") < F.floor(F.col("__n") / size))
        .drop("__pos", "__n")
    )


def epoch_order(df: DataFrame, id_col: str, epochs: int, seed: int) -> DataFrame:
    """`epoch`, `pos` of every row in a sequence of independent permutations."""
    from datasheaf.functions.hashing import digest

    copies = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    shuffled = copies.withColumn("__h", digest(seed, "epoch", id_col))
    return group_index(shuffled, "epoch", ["__h", id_col], "pos").drop("__h")


def explode_choices(
    df: DataFrame, id_col: str, context: Column, header: Column, endings: Sequence[Column]
) -> DataFrame:
    """One row per (context, header + ending) choice."""
    second = F.array(*[F.concat_ws(" ", header, e) for e in endings])
    return df.select(
        id_col, context.alias("first"), F.posexplode(second).alias("choice", "second")
    )


def regroup_choices(df: DataFrame, id_col: str, value: str) -> DataFrame:
    """The choices of an example back in one array, in choice order."""
    pairs = F.array_sort(F.collect_list(F.struct("choice", value)))
    return df.groupBy(id_col).agg(F.transform(pairs, lambda s: s[value]).alias(value + "s"))


def collate(df: DataFrame, batch: str, order_by: str, *columns: str) -> DataFrame:
    """One row per batch with an ordered array of row structs."""
    rows = F.array_sort(F.collect_list(F.struct(order_by, *columns)))
    return df.groupBy(batch).agg(rows.alias("rows"))
