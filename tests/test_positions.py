"""Positions and running aggregates against plain Python, over many ranges and hot groups."""

import random
import re

import pytest
from pyspark.sql import functions as F

from datasheaf.operators import positions as P
from datasheaf.operators.trials import best_so_far, ema, plateau_trigger


def rows(n=600, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", "é'\\", None])
        out.append((g, rnd.choice([None, 1.5, -2.0, 0.0, 7.25]), i, rnd.randint(-5, 5)))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), "g string, x double, id long, v long").repartition(5).persist()


def asc(v):
    return (v is not None, v if v is not None else 0)


def desc(v):
    return (v is None, -(v if v is not None else 0))


@pytest.mark.parametrize("partitions", [1, 7, 64])
@pytest.mark.parametrize("size", [10, 97, 100000])
def test_global_index(spark, df, partitions, size):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = P.global_index(df, ["x", "-id"], rows_per_range=size).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = sorted(rows(), key=lambda r: (asc(r[1]), -r[2]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["pos"])] == [r[2] for r in want]
    assert sorted(r["pos"] for r in got) == list(range(len(want)))


@pytest.mark.parametrize("size", [10, 60, 100000])
def test_group_index_spreads_hot_groups(df, size):
    got = {r["id"]: r["pos"] for r in P.group_index(df, "g", ["-x", "id"], rows_per_range=size).collect()}
    groups = {}
    for r in sorted(rows(), key=lambda r: (desc(r[1]), r[2])):
        k = groups.setdefault(r[0], [])
        assert got[r[2]] == len(k)
        k.append(r)


@pytest.mark.parametrize("how,start", [("sum", 0), ("max", None), ("min", None)])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("size", [13, 100000])
def test_running(df, how, start, inclusive, size):
    out = P.running(df, F.col("v"), "id", "g", how, inclusive, "r", size).collect()
    got = {r["id"]: r["r"] for r in out}
    pick = {"sum": lambda a, b: a + b, "max": max, "min": min}[how]
    state = {}
    for g, _, i, v in sorted(rows(), key=lambda r: r[2]):
        before = state.get(g, start)
        after = v if before is None else pick(before, v)
        assert got[i] == (after if inclusive else before)
        state[g] = after


def test_ranges_are_really_many(df):
    rows = P.placed(df, [("g", False), ("id", False)], 10)
    assert rows.select(P._RANGE).distinct().count() > 40


def test_five_thousand_ranges(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 20_011).alias("k"), (F.col("id") % 3).alias("g"), F.lit(2).cast("long").alias("v"))
    rows = {r.k: r for r in df.collect()}
    order = sorted(rows)
    got = {r.k: r.pos for r in P.global_index(df, "k", rows_per_range=2).collect()}
    assert got == {k: i for i, k in enumerate(order)}


def test_hot_groups_go_through_ranges(df, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_GROUP", 50)
    got = {r.id: r.pos for r in P.group_index(df, "g", ["-x", "id"]).collect()}
    monkeypatch.setattr(P, "ROWS_PER_GROUP", 10**6)
    assert got == {r.id: r.pos for r in P.group_index(df, "g", ["-x", "id"]).collect()}


@pytest.mark.parametrize("inclusive", [True, False])
def test_sums_of_several_columns(df, inclusive):
    values = {"a": F.col("v"), "b": F.col("x"), "n": None}
    state = {"a": 0, "b": 0.0, "n": 0}
    got = {r.id: r for r in P.running_many(df, values, "id", inclusive=inclusive, rows_per_range=40).collect()}
    for _, x, i, v in sorted(rows(), key=lambda r: r[2]):
        after = {"a": state["a"] + v, "b": state["b"] + (x or 0), "n": state["n"] + 1}
        want = after if inclusive else state
        assert (got[i].a, got[i].b, got[i].n) == (want["a"], pytest.approx(want["b"]), want["n"])
        assert got[i].v == v and got[i].x == x
        state = after


def test_input_is_read_twice_at_most(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1000).mapInArrow(count, "id long")
    out = P.running(df, F.col("id"), "-id", how="max", out="m")
    assert out.count() == 1000 and out.agg(F.min("m")).first()[0] == 999
    assert seen.value <= 2000


def test_instants_as_keys(spark):
    t = spark.range(300).select(F.timestamp_micros(F.col("id") * -1_000_001).alias("t"), "id").repartition(3)
    got = {r["id"]: r["pos"] for r in P.global_index(t, "t", rows_per_range=20).collect()}
    assert got == {i: 299 - i for i in range(300)}
    assert P.global_index(t, "t", rows_per_range=20).columns == ["t", "id", "pos"]


def test_plan_spreads_the_order(df):
    plan = P.global_index(df, "id", rows_per_range=50)._jdf.queryExecution().executedPlan().toString()
    # Only the counts of the ranges, a row each, meet in one task.
    assert plan.count("SinglePartition") == 1 and "BroadcastHashJoin" in plan
    assert re.search(r"Exchange SinglePartition.*\n.*HashAggregate\(keys=\[__ds_range", plan)
    plan = P.group_index(df, "g", "id", rows_per_range=50)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(g#\d+, __ds_range", plan)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, id long")
    assert P.global_index(empty, "id").collect() == []
    assert P.group_index(empty, "g", "id", rows_per_range=1).collect() == []


def test_slices():
    assert P.slice_bounds("[:10]", 100) == (0, 10)
    assert P.slice_bounds("[25%:50%]", 8) == (2, 4)
    assert P.slice_bounds("[-3:]", 8) == (5, 8)
    assert P.slice_bounds("[5:200]", 8) == (5, 8)


def series(n=300, seed=5):
    rnd = random.Random(seed)
    return [("k" if i % 3 else "j", i, float(rnd.randint(0, 40))) for i in range(n)]


@pytest.mark.parametrize("chunk", [4, 64])
def test_ema_in_chunks(spark, chunk, monkeypatch):
    from datasheaf.operators import trials

    monkeypatch.setattr(trials.linear_scan, "__defaults__", (chunk,))
    s = spark.createDataFrame(series(), "k string, step long, v double")
    got = {r["step"]: r["ema"] for r in ema(s, ["k"], "step", "v", 0.9).collect()}
    state = {}
    for k, i, v in series():
        state[k] = v if k not in state else 0.9 * state[k] + 0.1 * v
        assert got[i] == pytest.approx(state[k], abs=1e-9)


def test_best_and_plateau(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_RANGE", 20)
    s = spark.createDataFrame(series(), "k string, step long, v double")
    best = {r["step"]: (r["best"], r["best_step"]) for r in best_so_far(s, ["k"], "step", "v").collect()}
    high = {r["step"]: (r["best"], r["best_step"]) for r in best_so_far(s, ["k"], "step", "v", smaller=False).collect()}
    trig = {r["step"]: r["triggered"] for r in plateau_trigger(s, ["k"], "step", "v", 2).collect()}
    lo, hi, hist = {}, {}, {}
    for k, i, v in series():
        if k not in lo or v < lo[k][0]:
            lo[k] = (v, i)
        if k not in hi or v > hi[k][0]:
            hi[k] = (v, i)
        h = hist.setdefault(k, [])
        h.append(min(v, h[-1]) if h else v)
        assert best[i] == lo[k] and high[i] == hi[k]
        assert trig[i] == (len(h) > 3 and v > min(h[:-3]))
