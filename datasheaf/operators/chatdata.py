"""Conversation tables: rendering and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasheaf.functions.chat import render_messages, render_turn
from datasheaf.operators.positions import running


def render_conversations(
    turns: DataFrame, conv: str, turn: str, role: str, content: str, part_chars: int
) -> DataFrame:
    """`conv`, `part`, `text`: every conversation rendered in turn order.

    The caller says how long a part may be: the text of a conversation is one part unless it exceeds `part_chars`; a longer one goes on in
    parts 1, 2, ..., so no conversation is ever gathered whole. Concatenated parts give the text.
    """
    lines = turns.select(conv, turn, render_turn(F.col(role), F.col(content)).alias("line")).filter(
        F.col("line").isNotNull()
    )
    placed = running(
        lines.withColumn("__n", F.length("line").cast("long")), F.col("__n"), turn, conv,
        inclusive=False, out="__before",
    ).withColumn("part", F.floor(F.col("__before") / part_chars))
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(turn, "line"))), lambda s: s["line"]), ""
    )
    start = F.when(F.col("part") == 0, F.lit("\n")).otherwise(F.lit(""))
    return placed.groupBy(conv, "part").agg(text.alias("text")).withColumn("text", F.concat(start, "text"))


def preference_from_chat(chosen: Column, rejected: Column) -> tuple[Column, Column, Column]:
    """prompt, chosen, rejected texts of two message arrays: all but the last message, and the lasts."""
    prompt = F.slice(chosen, F.lit(1), F.greatest(F.size(chosen) - 1, F.lit(0)))

    def last(m: Column) -> Column:
        return render_messages(F.array(F.element_at(m, -1)))

    return render_messages(prompt), last(chosen), last(rejected)


def preference_from_triplet(
    prompt: Column, chosen: Column, rejected: Column, system: Column | None = None
) -> tuple[Column, Column, Column]:
    """The same for plain texts; a system text goes in front of the prompt with a newline."""
    def one(role: str, content: Column) -> Column:
        return render_messages(F.array(F.struct(F.lit(role).alias("role"), content.alias("content"))))

    full = prompt if system is None else F.concat(F.coalesce(F.concat(system, F.lit("\n")), F.lit("")), prompt)
    return one("user", full), one("assistant", chosen), one("assistant", rejected)
