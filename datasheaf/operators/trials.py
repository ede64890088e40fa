"""Metric series, checkpoints, leaderboards and successive halving over trial tables."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasheaf.operators.positions import group_index, running, shifted


def best_so_far(
    df: DataFrame, trial: Sequence[str], step: str, metric: str, smaller: bool = True
) -> DataFrame:
    """Adds `best` and `best_step`: the running best and where it was first reached."""
    first = F.col(step) if smaller else -F.col(step)
    value = F.struct(F.col(metric).alias("m"), first.alias("s"))
    out = running(df, value, step, trial, how="min" if smaller else "max", out="__b")
    at = F.col("__b.s") if smaller else -F.col("__b.s")
    return out.withColumn("best", F.col("__b.m")).withColumn("best_step", at).drop("__b")


def plateau_trigger(df: DataFrame, trial: Sequence[str], step: str, loss: str, nonmono: int) -> DataFrame:
    """Adds `triggered`: the loss exceeds the best of all entries but the last nonmono + 1.

    The running minimum is looked up nonmono + 1 positions earlier by an equi-join.
    """
    placed = group_index(df, trial, step, "__pos")
    low = running(placed, F.col(loss), "__pos", trial, how="min", out="__low")
    out = shifted(low, list(trial), "__pos", nonmono + 1, ["__low"], "_then")
    return out.withColumn("triggered", F.coalesce(F.col(loss) > F.col("__low_then"), F.lit(False))).drop(
        "__pos", "__low", "__low_then"
    )


def linear_scan(df: DataFrame, key: Sequence[str], pos: str, a: Column, c: Column, out: str, chunk: int = 64) -> DataFrame:
    """State s(i) = a(i) * s(i-1) + c(i) along a dense 0-based `pos` of each key, with a(0) = 0.

    Rows are folded in chunks of `chunk` positions; the chunks' composed maps form a series `chunk`
    times shorter, scanned the same way. So a series of any length is spread over tasks and no
    group exceeds the chunk size.
    """
    rows = df.select(*key, pos, a.alias("a"), c.alias("c"))
    longest = rows.agg(F.max(pos)).first()[0] or 0
    states = _scan(rows, list(key), pos, int(longest), chunk, out)
    return df.join(states, [*key, pos])


def _scan(rows: DataFrame, key: list[str], pos: str, longest: int, chunk: int, out: str) -> DataFrame:
    parts = rows.groupBy(*key, F.floor(F.col(pos) / chunk).alias("__k")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), "a", "c"))).alias("__rows")
    )
    if longest >= chunk:
        unit = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("c"))
        composed = F.aggregate(
            "__rows", unit,
            lambda m, r: F.struct((r["a"] * m["a"]).alias("a"), (r["a"] * m["c"] + r["c"]).alias("c")),
        )
        maps = parts.select(*key, "__k", composed.alias("m")).select(*key, "__k", "m.a", "m.c")
        ends = _scan(maps, key, "__k", longest // chunk, chunk, "__end")
        carry = ends.select(*key, (F.col("__k") + 1).alias("__k"), F.col("__end").alias("__in"))
        parts = parts.join(carry, [*key, "__k"], "left").withColumn("__in", F.coalesce("__in", F.lit(0.0)))
    else:
        parts = parts.withColumn("__in", F.lit(0.0))
    zero = F.struct(F.col("__in").alias("s"), F.array().cast("array<struct<p:bigint,s:double>>").alias("l"))

    def step(acc: Column, r: Column) -> Column:
        s = r["a"] * acc["s"] + r["c"]
        row = F.struct(r["p"].cast("bigint").alias("p"), s.alias("s"))
        return F.struct(s.alias("s"), F.concat(acc["l"], F.array(row)).alias("l"))

    folded = F.aggregate("__rows", zero, step, lambda acc: acc["l"])
    return parts.select(*key, F.explode(folded).alias("x")).select(
        *key, F.col("x.p").alias(pos), F.col("x.s").alias(out)
    )


def ema(df: DataFrame, trial: Sequence[str], step: str, value: str, mu: float) -> DataFrame:
    """Adds `ema`: mu * previous + (1 - mu) * value, starting at the first value."""
    placed = group_index(df, trial, step, "__pos")
    first = F.col("__pos") == 0
    v = F.col(value).cast("double")
    return linear_scan(
        placed, trial, "__pos", F.when(first, 0.0).otherwise(mu), F.when(first, v).otherwise(v * (1.0 - mu)), "ema"
    ).drop("__pos")


def top_checkpoint(df: DataFrame, experiment: str, metric: str, step: str, smaller: bool = True) -> DataFrame:
    """`experiment`, best (step, metric; the earlier step on ties) and the latest step."""
    order = F.struct(F.col(metric) if smaller else -F.col(metric), F.col(step))
    return df.groupBy(experiment).agg(
        F.min_by(step, order).alias("best_step"), F.min_by(metric, order).alias("best_metric"),
        F.max(step).alias("latest_step"),
    )


def rung_units(searches: DataFrame, search: str, max_length: Column, num_rungs: int, divisor: int) -> DataFrame:
    """`search`, rung, units: running sum of max(int(max_length / divisor^(num_rungs - rung - 1)), 1)."""
    units, rows = F.lit(0).cast("long"), []
    for r in range(num_rungs):
        share = F.floor(max_length / F.lit(float(divisor ** (num_rungs - r - 1)))).cast("long")
        units = units + F.greatest(share, F.lit(1).cast("long"))
        rows.append(F.struct(F.lit(r).alias("rung"), units.alias("units")))
    return searches.select(search, F.explode(F.array(*rows)).alias("x")).select(search, "x.*")


def rung_promotions(
    results: DataFrame, search: str, trial: str, num_rungs: int, divisor: int, smaller: bool = True,
    units: DataFrame | None = None,
) -> DataFrame:
    """Synchronous audit: `search`, rung, trial, rank, promoted.

    With `units` (search, rung, units) also `add`: what a promoted trial trains on for, at least one.

    `results`: search, trial, rung, metric, arrival, exited_early. Rung 0 holds every trial; a rung
    promotes the best floor(n / divisor) (early exits rank last, equal metrics by arrival) and the
    next rung holds those. The last rung promotes nobody. One pass per rung.
    """
    sign = 1 if smaller else -1
    member = results.filter("rung = 0").select(search, trial)
    out = None
    for r in range(num_rungs):
        here = results.filter(F.col("rung") == r).join(member, [search, trial])
        here = here.withColumn("__m", F.when(F.col("exited_early"), float("inf")).otherwise(sign * F.col("metric")))
        ranked = group_index(here, search, ["__m", "arrival", trial], "rank")
        size = here.groupBy(search).agg(F.floor(F.count(F.lit(1)) / divisor).alias("__q"))
        last = r == num_rungs - 1
        part = ranked.join(size, search).select(
            search, "rung", trial, "rank", (F.lit(not last) & (F.col("rank") < F.col("__q"))).alias("promoted")
        )
        out = part if out is None else out.unionByName(part)
        member = part.filter("promoted").select(search, trial)
    if units is None:
        return out
    here = units.select(search, "rung", F.col("units").alias("__u"))
    ahead = units.select(search, (F.col("rung") - 1).alias("rung"), F.col("units").alias("__a"))
    add = F.when(F.col("promoted"), F.greatest(F.col("__a") - F.col("__u"), F.lit(1).cast("long")))
    return out.join(here, [search, "rung"], "left").join(ahead, [search, "rung"], "left").withColumn("add", add).drop("__u", "__a")


ASYNC_SCHEMA = "search string, arrival long, rung int, promoted string"
WORST = float("inf")


class Halving:
    """One asynchronous search: of each rung's n results, the best floor(n / divisor) go on.

    A rung is two heaps. `chosen`, worst on top, holds the results that are among the best now, and all
    of them went on. `waiting`, best on top, holds the others, with a mark on those that went on before a
    better one took their place. Equal metrics keep their order of arrival. The last of `rungs` rungs sends
    nobody on. A trial that exited early counts as the worst result, and when it goes on it is at once a
    worst result of the next rung.
    """

    def __init__(self, divisor: int, rungs: int | None = None, kept: tuple | None = None):
        self.divisor, self.rungs = divisor, rungs
        self.levels, self.gone, self.serial = kept or ({}, set(), 0)

    def kept(self) -> tuple:
        """What a later instance needs to go on from here."""
        return self.levels, self.gone, self.serial

    def settle(self, level: int, trial: str, metric: float) -> str | None:
        """Enter a result; the trial that goes on because of it, if any."""
        chosen, waiting = self.levels.setdefault(level, ([], []))
        self.serial += 1
        key = (metric, self.serial)
        if (len(chosen) + len(waiting) + 1) // self.divisor > len(chosen):
            metric, serial, trial, went_on = heapq.heappushpop(waiting, (*key, trial, False))
            heapq.heappush(chosen, (-metric, -serial, trial))
            return None if went_on else trial
        if chosen and key < (-chosen[0][0], -chosen[0][1]):
            metric, serial, other = heapq.heapreplace(chosen, (-key[0], -key[1], trial))
            heapq.heappush(waiting, (-metric, -serial, other, True))
            return trial
        heapq.heappush(waiting, (*key, trial, False))
        return None

    def result(self, level: int, trial: str, metric: float | None, exited_early: bool = False) -> list[tuple[int, str]]:
        """Trials that go on because of a result, with the rung they leave. No metric counts as the worst."""
        if exited_early:
            self.gone.add(trial)
        if exited_early or metric is None or metric != metric:
            metric = WORST
        sent: list[tuple[int, str]] = []
        while self.rungs is None or level < self.rungs - 1:
            ahead = self.settle(level, trial, metric)
            if ahead is None:
                break
            sent.append((level, ahead))
            if ahead not in self.gone:
                break
            level, trial, metric = level + 1, ahead, WORST
        return sent


def rung_async(results: DataFrame, search: str, divisor: int, rungs: int | None = None) -> DataFrame:
    """Promotions of asynchronous halving, replayed in order of arrival.

    `results`: search, rung, trial, metric, arrival, and exited_early if there are early exits. A decision
    depends on all earlier ones of its search, so a search is one sorted run of rows; they pass through
    their task one after the other and only the metrics stay.
    """
    early = F.coalesce("exited_early", F.lit(False)) if "exited_early" in results.columns else F.lit(False)
    named = results.select(
        F.col(search).cast("string").alias("search"), F.col("rung").cast("int").alias("rung"),
        F.col("trial").cast("string").alias("trial"), F.col("metric").cast("double").alias("metric"), "arrival",
        early.alias("exited_early"),
    )

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if state is None or r.search != current:
                    current, state = r.search, Halving(divisor, rungs)
                rows += [(current, r.arrival, level, t) for level, t in state.result(r.rung, r.trial, r.metric, r.exited_early)]
            yield pd.DataFrame(rows, columns=["search", "arrival", "rung", "promoted"])

    order = named.repartition("search").sortWithinPartitions("search", "arrival", "rung", "trial")
    return order.mapInPandas(replay, ASYNC_SCHEMA)


def search_progress(results: DataFrame, search: str, max_trials: str, max_concurrent: int) -> DataFrame:
    """`search`, progress. `results` (rung 0): search, the `max_trials` column, done, invalid,
    pending flags. More pending trials than allowed fails the job."""
    s = results.groupBy(search).agg(
        F.count_if("done").alias("n"), F.count_if(F.col("done") & ~F.col("invalid")).alias("valid"),
        F.count_if("pending").alias("pending"), F.max(max_trials).alias("m"),
    )
    ok = F.assert_true(
        (F.lit(max_concurrent) <= 0) | (F.col("pending") <= max_concurrent), F.lit("more pending than concurrent trials")
    )
    base = F.col("n") / (1.2 * F.col("m"))
    progress = F.when(F.col("n") == F.col("m"), F.greatest(F.col("valid") / F.col("m"), base)).otherwise(base)
    return s.filter(ok.isNull()).select(search, progress.alias("progress"))


def leaderboard(df: DataFrame, experiment: str, trial: str, metric: str, smaller: bool = True) -> DataFrame:
    """Adds `rank` (equal metrics share a rank): one plus the number of better trials, from a
    running count over the distinct metrics of an experiment."""
    counts = df.groupBy(experiment, metric).agg(F.count(F.lit(1)).alias("__n"))
    order = metric if smaller else "-" + metric
    better = running(counts, F.col("__n"), order, experiment, inclusive=False, out="__b")
    ranks = better.select(experiment, metric, (F.col("__b") + 1).cast("long").alias("rank"))
    return df.join(ranks, [experiment, metric])


def metric_curve(df: DataFrame, x: Column, hue: str, value: str) -> DataFrame:
    return df.groupBy(hue, x.alias("x")).agg(F.avg(value).alias("y"), F.count(F.lit(1)).alias("n"))


def step_rollup(df: DataFrame, series: str, step: Column, every: int, value: str) -> DataFrame:
    """Count, mean and last step of each interval of `every` steps."""
    return df.groupBy(series, F.floor(step / every).alias("interval")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(step).alias("last_step")
    )
