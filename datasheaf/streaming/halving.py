"""Asynchronous successive halving as a decision stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from datasheaf.operators.trials import ASYNC_SCHEMA, Halving


def rung_stream(results: DataFrame, search: str, divisor: int, rungs: int | None = None) -> DataFrame:
    """Promotions of a stream of results (search, rung, trial, metric, arrival, exited_early).

    State per search is the metrics of its rungs. Within a batch results go by (arrival, rung, trial);
    across batches the order is that of the batches.
    """
    named = results.select(
        F.col(search).cast("string").alias("search"), F.col("rung").cast("int").alias("rung"),
        F.col("trial").cast("string").alias("trial"), F.col("metric").cast("double").alias("metric"), "arrival",
        F.coalesce("exited_early", F.lit(False)).alias("exited_early"),
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = pickle.loads(state.get[0]) if state.exists else None
        halving = Halving(divisor, rungs, kept)
        rows = pd.concat(list(batches)).sort_values(["arrival", "rung", "trial"])
        out = [
            (key[0], r.arrival, level, t)
            for r in rows.itertuples(index=False) for level, t in halving.result(r.rung, r.trial, r.metric, r.exited_early)
        ]
        state.update((pickle.dumps(halving.kept()),))
        yield pd.DataFrame(out, columns=["search", "arrival", "rung", "promoted"])

    return named.groupBy("search").applyInPandasWithState(
        step, ASYNC_SCHEMA, "kept binary", "append", GroupStateTimeout.NoTimeout
    )
