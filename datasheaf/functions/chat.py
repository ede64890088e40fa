"""Chat rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from datasheaf.functions.text import strip

# Turn markers, the system prompt and the task layout.
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"
ASSISTANT_PREFIX = "<|im_start|>assistant\n"
SYSTEM_PROMPT = (
    "You are a helpful programmer assistant that excels at SQL. "
    "When prompted with a task and a definition of an SQL table, you "
    "respond with a SQL query to retrieve information from the table. "
    "Don't explain your reasoning, only provide the SQL query."
)


def render_turn(role: Column, content: Column) -> Column:
    """One message with its markers and a closing newline; NULL for an unknown role.

    User and system text is stripped, assistant text is kept as written.
    """
    body = F.when(role.isin("user", "system"), strip(content)).when(role == "assistant", content)
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), body, F.lit(TURN_END + "\n"))


def render_messages(messages: Column) -> Column:
    """A list of {role, content} as one text: a newline, then a line per message."""
    turns = F.transform(messages, lambda m: render_turn(m["role"], m["content"]))
    return F.concat(F.lit("\n"), F.array_join(F.filter(turns, lambda t: t.isNotNull()), ""))


def sql_task_prompt(instruction: Column, table: Column) -> Column:
    return F.concat(
        F.lit("Task: "), instruction, F.lit("\nSQL table: "), table, F.lit("\nSQL query: ")
    )


def sql_task_messages(
    instruction: Column, table: Column, response: Column | None = None, merge_system: bool = False
) -> Column:
    """Messages of one text-to-SQL record; `merge_system` puts the system text into the user turn."""
    prompt = sql_task_prompt(instruction, table)

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    if merge_system:
        turns = [message("user", F.concat(F.lit(SYSTEM_PROMPT + "\n"), prompt))]
    else:
        turns = [message("system", F.lit(SYSTEM_PROMPT)), message("user", prompt)]
    if response is not None:
        turns.append(message("assistant", response))
    return F.array(*turns)


def with_generation_prompt(text: Column) -> Column:
    return F.concat(text, F.lit(ASSISTANT_PREFIX))
