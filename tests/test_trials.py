"""Successive halving, splits, sampling, prototypes and extension points."""

import random

import pytest
from pyspark.sql import functions as F

from datasheaf.operators import classification as M
from datasheaf.operators import embeddings as E
from datasheaf.operators import joins as J
from datasheaf.operators import reducers as R
from datasheaf.operators import splits as X
from datasheaf.operators import trials as V


def replay(results, divisor):
    """(arrival, trial) of the rule: whoever is among the best floor(n / divisor) of n and was not sent on yet."""
    seen, sent, out = [], set(), []
    for arrival, trial, metric in results:
        seen.append((metric, len(seen), trial))
        best = {t for _, _, t in sorted(seen)[:len(seen) // divisor]}
        fresh = {trial} if trial in best else best - sent
        assert len(fresh) <= 1
        out += [(arrival, t) for t in fresh]
        sent |= fresh
    return out


@pytest.fixture(scope="module")
def results():
    rnd = random.Random(4)
    return [(s, 0, i, f"t{i}", float(rnd.randint(0, 12)), False) for i in range(120) for s in "pq"]


SCHEMA = "search string, rung int, arrival long, trial string, metric double, exited_early boolean"


def test_rung_async(spark, results):
    df = spark.createDataFrame(results, SCHEMA).repartition(6)
    got = {(r["search"], r["arrival"], r["promoted"]) for r in V.rung_async(df, "search", 3).collect()}
    want = {(s, a, t) for s in "pq" for a, t in replay([(r[2], r[3], r[4]) for r in results if r[0] == s], 3)}
    assert got == want


def test_rung_async_last_rung_and_early_exits(spark):
    rows = [
        ("s", 0, 1, "a", 5.0, False), ("s", 0, 2, "b", 0.0, True), ("s", 0, 3, "c", 9.0, True), ("s", 0, 4, "d", 4.0, False),
        ("s", 0, 5, "e", 3.0, True), ("s", 0, 6, "f", 6.0, True), ("s", 1, 7, "a", 1.0, False), ("s", 1, 8, "d", 2.0, False),
        ("s", 0, 9, "g", 7.0, True), ("s", 0, 10, "h", 8.0, True), ("s", 2, 11, "a", 0.0, False), ("s", 2, 12, "b", 0.0, False),
    ]
    got = V.rung_async(spark.createDataFrame(rows, SCHEMA), "search", 2, rungs=3).orderBy("arrival", "rung").collect()
    # Half of all go on, so b and c do although they exited early; each is then a worst result of rung 1.
    assert [(r.arrival, r.rung, r.promoted) for r in got] == [(2, 0, "a"), (4, 0, "d"), (6, 0, "b"), (7, 1, "a"), (10, 0, "c"), (10, 1, "d")]


def test_rung_promotions(spark):
    rows = [("s", 0, i, f"t{i}", m, e) for i, (m, e) in enumerate([(3.0, False), (1.0, False), (1.0, False), (0.0, True)])]
    rows += [("s", 1, 9, "t1", 5.0, False), ("s", 1, 10, "t2", 4.0, False), ("s", 1, 11, "t0", 0.0, False)]
    got = {(r["rung"], r["trial"]): (r["rank"], r["promoted"]) for r in V.rung_promotions(spark.createDataFrame(rows, SCHEMA), "search", "trial", 2, 2).collect()}
    assert got == {
        (0, "t1"): (0, True), (0, "t2"): (1, True), (0, "t0"): (2, False), (0, "t3"): (3, False),
        (1, "t2"): (0, False), (1, "t1"): (1, False),
    }


def test_rung_promotions_with_units(spark):
    rows = [("s", 0, i, f"t{i}", float(i), False) for i in range(4)] + [("s", 1, 9, "t0", 5.0, False)]
    units = spark.createDataFrame([("s", 0, 4), ("s", 1, 16)], "search string, rung int, units long")
    got = V.rung_promotions(spark.createDataFrame(rows, SCHEMA), "search", "trial", 2, 4, units=units).collect()
    assert {(r["rung"], r["trial"]): r["add"] for r in got} == {(0, "t0"): 12, (0, "t1"): None, (0, "t2"): None, (0, "t3"): None, (1, "t0"): None}


def test_rung_units(spark):
    df = spark.createDataFrame([("a", 100), ("b", 2)], "s string, n int")
    got = {(r["s"], r["rung"]): r["units"] for r in V.rung_units(df, "s", F.col("n"), 3, 4).collect()}
    assert got == {("a", 0): 6, ("a", 1): 31, ("a", 2): 131, ("b", 0): 1, ("b", 1): 2, ("b", 2): 4}


def test_search_progress(spark):
    rows = [("a", 2, True, False, False), ("a", 2, True, True, False), ("b", 4, True, False, False), ("b", 4, False, False, True)]
    df = spark.createDataFrame(rows, "s string, m int, done boolean, invalid boolean, pending boolean")
    assert {r[0]: r[1] for r in V.search_progress(df, "s", "m", 5).collect()} == {"a": pytest.approx(2 / 2.4), "b": pytest.approx(1 / 4.8)}
    with pytest.raises(Exception, match="pending"):
        V.search_progress(df.unionByName(df).unionByName(df), "s", "m", 2).collect()


@pytest.mark.parametrize("n", [1, 7, 10, 103])
def test_split_sizes(spark, n):
    df = spark.range(n)
    got = {r["split"]: r["count"] for r in X.split_three_way(df, "id").groupBy("split").count().collect()}
    train = int(n * 0.8 + 1e-9)
    rest = n - train
    assert got.get("train", 0) == train and got.get("test", 0) == -(-rest // 2) and sum(got.values()) == n
    tail = {r["id"]: r["split"] for r in X.split_tail(df, ["id"]).collect()}
    assert sum(v == "test" for v in tail.values()) == -int(-(n * 0.2) // 1)
    assert [tail[i] for i in range(n)] == sorted(tail.values(), reverse=True)


def test_split_is_independent_of_partitions(spark):
    a = {r["id"]: r["split"] for r in X.split_three_way(spark.range(50).repartition(1), "id").collect()}
    b = {r["id"]: r["split"] for r in X.split_three_way(spark.range(50).repartition(9), "id").collect()}
    assert a == b


def test_episodes(spark):
    df = spark.createDataFrame([(i, "hot" if i % 2 else f"c{i % 8}") for i in range(120)], "m long, c string")
    rows = X.sample_episodes(df, "m", "c", 3, 2, 3, 20).collect()
    assert len(rows) == 20 * 3 * 5
    for t in range(20):
        mine = [r for r in rows if r["task"] == t]
        assert len({r["c"] for r in mine}) == 3 and len({r["m"] for r in mine}) == 15
        assert {r["way"] for r in mine} == {0, 1, 2}


def test_completion_labels(spark):
    df = spark.createDataFrame([([5, 1, 2, 7, 1, 2],), ([5, 6],), ([1, 2],), ([],)], "t array<int>")
    got = [r[0] for r in df.select(X.completion_labels(F.col("t"), [1, 2])).collect()]
    assert got == [[-100, -100, -100, 7, 1, 2], [-100, -100], [-100, -100], []]


def test_repeat_factors(spark):
    rows = [(i, 1) for i in range(16)] + [(0, 2)]
    f = {r[0]: r[1] for r in X.repeat_factors(spark.createDataFrame(rows, "image_id long, category_id long"), 0.25).collect()}
    assert f[0] == pytest.approx(2.0) and f[1] == 1.0


@pytest.mark.parametrize("limit", [1_000_000, 12, 4])
def test_prototypes_in_blocks(spark, limit):
    rnd = random.Random(1)
    rows = [(i, i % 6, [rnd.gauss(i % 6, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, y int, v array<double>")
    protos = E.class_centroids(df, "y", "v")
    mean = {c: [sum(r[2][k] for r in rows if r[1] == c) / 10 for k in range(4)] for c in range(6)}
    got = {r["i"]: r for r in E.prototype_classify(df, "i", "v", protos, "y", inline_values=limit).collect()}
    import math

    for i, y, v in rows:
        d = {c: sum((a - b) ** 2 for a, b in zip(v, m)) for c, m in mean.items()}
        lse = math.log(sum(math.exp(-x) for x in d.values()))
        assert got[i]["pred"] == min(d, key=lambda c: (d[c], c))
        assert got[i]["loss"] == pytest.approx(d[y] + lse) and got[i]["log_prob"] == pytest.approx(-min(d.values()) - lse)
    top = E.knn_topk(protos, df, 3, "y", "i", "proto", "v", inline_values=limit).collect()
    for c in range(6):
        want = sorted((sum((a - b) ** 2 for a, b in zip(v, mean[c])), i) for i, _, v in rows)[:3]
        assert sorted((r["rank"], r["i"]) for r in top if r["query"] == c) == [(k + 1, i) for k, (_, i) in enumerate(want)]


def test_mean_pool_mask(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 0.0, 0.0], [1, 1, 0])], "v array<double>, m array<int>")
    r = df.select(E.mean_pool("v", 3, 2), E.mean_pool("v", 3, 2, F.col("m"))).first()
    assert r[0] == pytest.approx([4 / 3, 2.0]) and r[1] == pytest.approx([2.0, 3.0])


def test_f1_of_an_empty_class_is_null(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "p int, y int")
    classes = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    got = {r["label"]: r["f1"] for r in M.per_class_f1(M.confusion_matrix(df, "p", "y"), classes).collect()}
    assert got == {0: pytest.approx(2 / 3), 1: 0.0, 2: None}


def test_sem_seg_keeps_the_miou_denominator(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "p int, y int")
    classes = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    _, s = M.sem_seg_metrics(M.confusion_matrix(df, "p", "y"), classes, 9)
    r = s.first()
    assert r["miou"] == pytest.approx(100 * (2 / 3) / 2) and r["macc"] == pytest.approx(200 / 3)


def test_task_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 2.0)], "p double, y double")
    r = M.task_metrics(df, "stsb", "p", "y").first()
    assert r["spearman"] == pytest.approx(0.8660254) and r["combined_score"] == pytest.approx((r["pearson"] + r["spearman"]) / 2)


def test_attach_proposals_needs_every_image(spark):
    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    props = spark.createDataFrame([("1", [0.1, 0.9, 0.9], ["a", "b", "c"])], "id string, objectness_logits array<double>, boxes array<string>")
    ok = J.attach_proposals(images.filter("image_id = 1"), props).first()
    assert ok["boxes"] == ["b", "c", "a"] and ok["objectness_logits"] == [0.9, 0.9, 0.1]
    with pytest.raises(Exception, match="no proposals"):
        J.attach_proposals(images, props).collect()


def test_unknown_category_fails(spark):
    df = spark.createDataFrame([(1,), (5,)], "c int")
    m = spark.createDataFrame([(1, 0)], "c int, k int")
    with pytest.raises(Exception, match="unknown c"):
        J.lookup(df, m, "c").collect()
    assert J.lookup(df, m, "c", strict=False).count() == 2


def counter():
    """Defined inside a function, so it is sent to the workers by value."""
    class Counter(R.PartialReducer):
        def init(self):
            return {}

        def update(self, state, batch):
            for k, n in batch["k"].value_counts().items():
                state[k] = state.get(k, 0) + int(n)
            return state

        def merge(self, a, b):
            return {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}

        def finish(self, state):
            return {"kinds": len(state), "rows": sum(state.values())}

    return Counter()


@pytest.mark.parametrize("merge_tasks", [64, 2])
@pytest.mark.parametrize("parts", [2, 64, 65])
def test_partial_reducer(spark, merge_tasks, parts):
    tasks = spark.sparkContext.accumulator(0)
    plain = counter()

    class Counted(type(plain)):
        def init(self):
            return {}

        def update(self, state, batch):
            tasks.add(1)
            return plain.update(state, batch)

    df = spark.range(0, 1000, 1, parts).selectExpr("id % 7 AS k")
    r = R.reduce_partials(df, Counted(), "kinds long, rows long", merge_tasks).collect()
    assert [tuple(x) for x in r] == [(7, 1000)]
    # Every input partition has a batch of its own and its own task.
    assert tasks.value == parts


def test_evaluators(spark):
    df = spark.createDataFrame([(1, 1), (0, 1)], "p int, y int")
    fns = {"a": lambda d: d.agg(M.accuracy("p", "y").alias("acc")), "b": lambda d: d.agg(M.f1_binary("p", "y").alias("f1"))}
    got = {r["metric"]: r["value"] for r in R.evaluate_all(df, fns).collect()}
    assert got == {"a/acc": 0.5, "b/f1": pytest.approx(2 / 3)}
    with pytest.raises(ValueError, match="reported by"):
        R.evaluate_all(df, {"a": fns["a"], "c": fns["a"]})


def test_batched_map_and_grouped_callable(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, x double")
    m = R.map_batches(df, lambda b: b.assign(y=b["x"] * 2)[["y"]], "y double", remove_columns=["g"])
    assert sorted(r["y"] for r in m.collect()) == [2.0, 6.0, 10.0]
    med = R.wrap_reducer(lambda v: v.median())
    assert {r[0]: r[1] for r in df.groupBy("g").agg(med("x")).collect()} == {"a": 2.0, "b": 5.0}
