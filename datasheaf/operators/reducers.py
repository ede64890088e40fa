"""Extension points: user-defined partial reducers, grouped callables, batched maps, evaluators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PartialReducer:
    """A reduction in two phases: `update` folds batches into a state per task, `merge` joins states.

    Override the four methods. States must be small: one per task (and key) is shuffled. Prefer plain
    aggregates where they can say the same.
    """

    def init(self) -> Any:
        raise NotImplementedError

    def update(self, state: Any, batch: pd.DataFrame) -> Any:
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def finish(self, state: Any) -> dict[str, Any]:
        raise NotImplementedError


# Tasks that merge partial states before the last one: their states are what it takes.
FAN_IN = 64


def reduce_partials(df: DataFrame, reducer: PartialReducer, schema: str, merge_tasks: int = FAN_IN) -> DataFrame:
    """One row with the reducer's result over all rows of `df`.

    Each task of the input sends one pickled state. `merge_tasks` tasks merge them, and one task merges
    their states: an exchange stands before either, so the input keeps its own tasks. More than
    `merge_tasks` squared input tasks are no limit, a merging task only takes more states in turn.
    """
    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = reducer.init()
        for b in batches:
            state = reducer.update(state, b)
        yield pd.DataFrame({"state": [pickle.dumps(state)]})

    def merged(batches: Iterator[pd.DataFrame]) -> Any:
        state = reducer.init()
        for b in batches:
            for s in b["state"]:
                state = reducer.merge(state, pickle.loads(s))
        return state

    def merge_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"state": [pickle.dumps(merged(batches))]})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([reducer.finish(merged(batches))])

    states = df.mapInPandas(partials, "state binary").repartition(merge_tasks).mapInPandas(merge_states, "state binary")
    return states.repartition(1).mapInPandas(finish, schema)


def wrap_reducer(fn: Callable[[pd.Series], float]) -> Callable[[Column], Column]:
    """A callable over all values of a group as an aggregate, for groups known to be small."""
    @F.pandas_udf("double")
    def agg(v: pd.Series) -> float:
        return float(fn(v))

    return agg


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, remove_columns: Sequence[str] = ()
) -> DataFrame:
    """Batched map over Arrow batches; only the columns that are left are sent to Python."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.drop(*remove_columns).mapInPandas(run, schema)


def evaluate_all(df: DataFrame, evaluators: dict[str, dict[str, Column] | Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """`metric`, `value` of several evaluators over one prediction table.

    An evaluator is a dict of aggregate columns by metric, all of which go into one pass over the table, or a
    function that gives one row of numbers and reads the table by itself. A metric name that two evaluators
    report is an error; the name carries the evaluator in front.
    """
    seen: dict[str, str] = {}

    def claim(name: str, metrics: Sequence[str]) -> None:
        for c in metrics:
            if c in seen:
                raise ValueError(f"metric {c} is reported by {seen[c]} and {name}")
            seen[c] = name

    def long(row: DataFrame) -> DataFrame:
        return row.unpivot([], row.columns, "metric", "value")

    together, out = [], None
    for name, one in evaluators.items():
        if callable(one):
            row = one(df)
            claim(name, row.columns)
            part = long(row.select(*[F.col(c).cast("double").alias(f"{name}/{c}") for c in row.columns]))
            out = part if out is None else out.unionByName(part)
        else:
            claim(name, list(one))
            together += [value.cast("double").alias(f"{name}/{c}") for c, value in one.items()]
    if together:
        part = long(df.agg(*together))
        out = part if out is None else part.unionByName(out)
    return out
