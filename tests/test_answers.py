"""Span answers, entities, BLEU and packing on small hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from datasheaf.functions.hashing import draw, draw_int, draw_ints, draws
from datasheaf.operators import corpus as C
from datasheaf.operators import entities as N
from datasheaf.operators import language as L
from datasheaf.operators import packing as P
from datasheaf.operators import qa as Q

OFFSETS = "array<struct<s:int,e:int>>"
FEATURES = f"id string, window int, context string, offsets {OFFSETS}, start_logits array<double>, end_logits array<double>"


@pytest.fixture(scope="module")
def features(spark):
    text, offs = "ab cd ef", [None, (0, 2), (3, 5), (6, 8)]
    return spark.createDataFrame(
        [
            ("x", 0, text, offs, [1.0, 5.0, 2.0, 0.0], [1.0, 0.0, 4.0, 3.0]),
            ("x", 1, text, offs, [-3.0, 1.0, 1.0, 1.0], [0.5, 1.0, 1.0, 1.0]),
            ("y", 0, text, [None] * 4, [0.0] * 4, [0.0] * 4),
        ],
        FEATURES,
    )


def sequential(rows, n, max_len):
    out = []
    for _, w, text, offs, s, e in rows:
        top = lambda v: sorted(range(len(v)), key=lambda i: (-v[i], i))[:n]
        for a in top(s):
            for b in top(e):
                if offs[a] and offs[b] and a <= b <= a + max_len - 1:
                    out.append((-(s[a] + e[b]), w, a, b, text[offs[a][0]:offs[b][1]]))
    return sorted(out)


@pytest.mark.parametrize("n,max_len", [(20, 30), (2, 30), (20, 2), (3, 1)])
def test_n_best(features, n, max_len):
    rows = [tuple(r) for r in features.filter("id = 'x'").collect()]
    rows = [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in rows]
    want = sequential(rows, n, max_len)[:n]
    got = Q.n_best(Q.span_candidates(features, n, max_len, best=n), "id", n).filter("id = 'x'").orderBy("rank").collect()
    assert [(-r["score"], r["window"], r["start"], r["end"], r["text"]) for r in got] == want


def test_null_answer_and_fallback(features):
    best = Q.n_best(Q.span_candidates(features, best=20), "id")
    nulls = Q.null_scores(features, "id")
    n = {r["id"]: r["null_score"] for r in nulls.collect()}
    assert n == {"x": -2.5, "y": 0.0}
    a = {r["id"]: (r["answer"], r["score_diff"]) for r in Q.null_answer(best, nulls, "id").collect()}
    assert a == {"x": ("ab cd", -11.5), "y": ("empty", 0.0)}
    strict = {r["id"]: r["answer"] for r in Q.null_answer(best, nulls, "id", threshold=-12.0).collect()}
    assert strict["x"] == ""
    full = Q.with_fallback(best, features, "id")
    assert [r["text"] for r in full.filter("id = 'y'").collect()] == ["empty"]
    p = Q.group_softmax(full.select("id", "rank", "score"), "id", "score").groupBy("id").agg(F.sum("probability")).collect()
    assert all(r[1] == pytest.approx(1.0) for r in p)
    with_null = Q.with_null(best, nulls, "id", n=2).filter("id = 'x'").orderBy("rank").collect()
    assert [r["is_null"] for r in with_null] == [0, 0, 1]


def test_answer_token_span(spark):
    offs = [None, (0, 2), (3, 5), (6, 8), None]
    df = spark.createDataFrame([(3, 8), (0, 2), (4, 5), (0, 9), (1, 4)], "a int, b int").withColumn(
        "o", F.array(*[F.lit(None).cast("struct<s:int,e:int>") if o is None else F.struct(F.lit(o[0]).alias("s"), F.lit(o[1]).alias("e")) for o in offs])
    )
    got = df.select(Q.answer_token_span(F.col("o"), F.col("a"), F.col("b"), F.lit(0)).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [(2, 3), (1, 1), (2, 2), (0, 0), (1, 2)]


def test_squad_scores(spark):
    rows = [("1", "the cat sat", ["cat sat", "dog"]), ("2", "cat cat", ["cat dog cat cat"]), ("3", "", []), ("4", "x", [])]
    df = spark.createDataFrame(rows, "id string, p string, g array<string>")
    s = Q.squad_em_f1(df, "id", "p", "g").first()
    assert s["exact_match"] == pytest.approx(50.0)
    assert s["f1"] == pytest.approx(100 * (1 + 2 * 2 / 6 + 1 + 0) / 4)


def test_entities(spark):
    rows = [
        (["B-PER", "I-PER", "O", "B-LOC"], ["B-PER", "I-PER", "O", "B-PER"]),
        (["I-LOC", "I-LOC", "I-PER", "B-PER"], ["I-LOC", "I-LOC", "O", "B-PER"]),
        (["O"], ["O"]),
    ]
    df = spark.createDataFrame(rows, "gold array<string>, pred array<string>")
    spans = [[tuple(x) for x in r[0]] for r in df.select(N.entity_spans("gold")).collect()]
    assert spans == [[("PER", 0, 1), ("LOC", 3, 3)], [("LOC", 0, 1), ("PER", 2, 2), ("PER", 3, 3)], []]
    strict = [[tuple(x) for x in r[0]] for r in df.select(N.entity_spans("gold", strict=True)).collect()]
    assert strict[1] == [("PER", 3, 3)]
    s = N.entity_scores(df, "pred", "gold").first()
    assert (s["precision"], s["recall"]) == (pytest.approx(3 / 4), pytest.approx(3 / 5))
    assert s["accuracy"] == pytest.approx(7 / 9)


def test_subtoken_labels(spark):
    df = spark.createDataFrame([([None, 0, 0, 1, None], [7, 8])], "w array<int>, l array<int>")
    got = df.select(N.subtoken_labels(F.col("w"), F.col("l")), N.subtoken_labels(F.col("w"), F.col("l"), True)).first()
    assert got[0] == [-100, 7, -100, 8, -100] and got[1] == [-100, 7, 7, 8, -100]


def test_bleu(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "a a a", "a b")], "i int, h string, r string")
    b = L.corpus_bleu(df, "i", "h", "r").first()
    p = [6 / 8, 4 / 6, 3 / 4, 2 / 2]
    assert [b[f"p{n}"] for n in range(1, 5)] == pytest.approx(p)
    assert b["bleu"] == pytest.approx(math.exp(sum(map(math.log, p)) / 4))
    none = L.corpus_bleu(df.filter("i = 2"), "i", "h", "r").first()
    assert none["bleu"] == 0.0
    same = L.corpus_bleu(df.filter("i = 1"), "i", "h", "r").first()
    assert same["bleu"] == pytest.approx(1.0)


def test_shifted_hits(spark):
    df = spark.createDataFrame([([1, 2, 3], [9, 1, -100]), ([1], [1]), ([], [])], "p array<int>, y array<int>")
    h, u = L.shifted_hits(F.col("p"), F.col("y"))
    assert [tuple(r) for r in df.select(h, u).collect()] == [(1, 1), (0, 0), (0, 0)]


def test_perplexity_overflow(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 4.0, 1), ("b", 1000.0, 1), ("c", float("nan"), 1)], "g string, x double, n int")
    got = {r[0]: r[1] for r in df.groupBy("g").agg(L.perplexity_weighted("x", "n")).collect()}
    assert got == {"a": pytest.approx(math.exp(2)), "b": 100000.0, "c": 100000.0}


@pytest.mark.parametrize("block,length", [(2, 3), (1000, 4), (3, 1)])
def test_pack_fixed(spark, block, length):
    rows = [(i, list(range(i * 10, i * 10 + n))) for i, n in enumerate([3, 0, 5, 1, 7, 2])]
    got = P.pack_fixed(spark.createDataFrame(rows, "i int, t array<int>"), "t", "i", length, block)
    want = {}
    for b in range(0, len(rows), block):
        flat = [x for _, t in rows[b:b + block] for x in t]
        for k in range(len(flat) // length):
            want[b // block, k] = flat[k * length:(k + 1) * length]
    assert {(r["block"], r["piece"]): r["tokens"] for r in got.collect()} == want


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 12, 30])
def test_sliding_windows(spark, n):
    df = spark.createDataFrame([(list(range(n)),)], "t array<int>")
    got = P.sliding_windows(df, "t", F.lit(2), 13, 3, specials=3).orderBy("window").collect()
    want, start = [], 0
    while True:
        want.append(list(range(start, min(start + 8, n))))
        if start + 8 >= n:
            break
        start += 5
    assert [r["window_tokens"] for r in got] == want


@pytest.mark.parametrize("rows,bptt", [(10, 3), (10, 9), (7, 3), (4, 10), (1, 2)])
def test_bptt_windows(spark, rows, bptt):
    cells = spark.createDataFrame([(r, c, f"{r}.{c}") for r in range(rows) for c in range(2)], "row long, col long, token string")
    got = {(r["window"], r["col"]): (r["inputs"], r["targets"]) for r in C.bptt_windows(cells, bptt).collect()}
    want = {}
    for i, start in enumerate(range(0, rows, bptt)):
        n = min(bptt, rows - 1 - start)
        for c in range(2):
            if n > 0:
                want[i, c] = ([f"{start + k}.{c}" for k in range(n)], [f"{start + k + 1}.{c}" for k in range(n)])
    assert got == want


def test_random_windows(spark):
    fixed = C.random_windows(spark, 30, 7, 5, fixed=True).orderBy("window").collect()
    assert [(r["start"], r["len"]) for r in fixed] == [(0, 7), (7, 7), (14, 7), (21, 6)]
    free = C.random_windows(spark, 400, 20, 5, seed=1).orderBy("window").collect()
    at = 0
    for r in free:
        assert r["start"] == at and 1 <= r["len"] <= 25
        at += r["len"]
    assert at == 397


def test_batches(spark):
    rows = [(i, [0] * n, w, h) for i, (n, w, h) in enumerate([(3, 2, 1), (1, 1, 1), (2, 1, 2), (5, 3, 1), (4, 3, 2)])]
    df = spark.createDataFrame(rows, "i int, t array<int>, w int, h int")
    by_len = {r["i"]: (r["batch"], r["width"]) for r in P.length_batches(df, "t", ["i"], 2).collect()}
    assert by_len == {1: (0, 2), 2: (0, 2), 0: (1, 4), 4: (1, 4), 3: (2, 5)}
    shapes = {r["i"]: (r["bucket"], r["batch"]) for r in P.aspect_batches(df, F.col("w"), F.col("h"), ["i"], 2).collect()}
    assert shapes == {0: (0, 0), 3: (0, 0), 1: (1, 0), 2: (1, 0)}


def test_spans_of_odd_windows(spark):
    # Missing lists, lists of unequal length, missing and infinite logits, an empty window, a long one among short ones.
    long = 3000
    rows = [
        ("a", "ab cd", [None, (0, 2), (3, 5)], [0.0, None, 2.0], [0.0, 1.0, float("nan")]),
        ("b", "ab", None, [1.0, 2.0], [1.0, 2.0]), ("c", "ab", [None, (0, 2)], None, [1.0, 2.0]), ("d", "", [], [], []),
        ("e", "ab cd", [(0, 2), (3, 5)], [float("inf"), 1.0, 9.0], [1.0]),
        ("f", " ".join(["x"] * long), [(2 * i, 2 * i + 1) for i in range(long)], [float(i % 7) for i in range(long)], [1.0] * long),
    ]
    df = spark.createDataFrame(rows, f"id string, context string, offsets {OFFSETS}, start_logits array<double>, end_logits array<double>")
    got = Q.span_candidates(df.coalesce(1), 2, 2).drop("start_logit", "end_logit").collect()
    by = lambda i: [(r.start, r.end, None if r.score is None else str(r.score), r.text) for r in got if r.id == i]
    assert by("a") == [(1, 1, None, "ab")]
    assert by("b") == by("c") == by("d") == []
    assert by("e") == [(0, 0, "inf", "ab")]
    assert by("f") == []  # best starts 6 and 13, best ends 0 and 1
    assert [r.text for r in Q.span_candidates(df.filter("id = 'f'"), 20, 1).collect()] == ["x"] * 2


def test_arrow_draws_are_the_draws(spark):
    df = spark.sql("select * from values (1L, 'x', 3), (null, 'y', 2), (2L, null, 0), (3L, 'z', null) as t(a, b, n)")
    one = lambda f: F.transform(F.sequence(F.lit(1), F.col("n")), f)
    got = df.select(
        "n", draw_ints("s", F.col("n"), "a", "b").alias("i"), draws("s", F.col("n"), "a", "b", low=-5.0, width=10.0).alias("d"),
        one(lambda k: draw_int("s", "a", "b", k - 1)).alias("wi"), one(lambda k: draw("s", "a", "b", k - 1) * 10 - 5).alias("wd"),
    ).collect()
    assert [(r.i, r.d) for r in got] == [([], []) if r.n == 0 else (r.wi, r.wd) for r in got]


def test_span_steps_are_made_once_and_by_batch(spark, features):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spans = plan(Q.span_candidates(features, best=20))
    assert spans.count("ArrowEvalPython") == 1 and "lambdafunction" not in spans
    words = spark.createDataFrame([(["ab", "c", None, "d"],), (None,), ([],)], "w array<string>")
    offsets = words.select(Q.word_offsets(F.col("w")).alias("o"))
    assert [r.o and [(x.s, x.e) for x in r.o] for r in offsets.collect()] == [[(0, 2), (3, 4), (None, None), (None, None)], None, []]
    span = Q.answer_token_span(F.col("o"), F.lit(3), F.lit(4), F.lit(0))
    assert [tuple(r.x) for r in offsets.select(span.alias("x")).collect()] == [(1, 1), (0, 0), (0, 0)]
    assert "lambdafunction" not in plan(offsets.select(span))


def test_fallback_makes_the_lists_once(spark, features):
    made = Q.n_best(Q.span_candidates(features, best=20), "id")
    full = Q.with_fallback(made, features, "id")
    assert full._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    lists = spark.createDataFrame([("a", 1, "", 1.0), ("b", 1, "", 1.0), ("b", 2, "", 0.5), ("c", 1, "t", 1.0), (None, 1, "t", 1.0), ("z", 1, "", 1.0)],
                                  "id string, rank int, text string, score double").withColumns({"start_logit": F.lit(0.0), "end_logit": F.lit(0.0)})
    every = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), (None,)], "id string")
    got = Q.with_fallback(lists, every, "id").filter("rank = 0").collect()
    assert sorted(str(r.id) for r in got) == ["None", "a", "d"]


def test_entity_spans_of_odd_tags(spark):
    rows = [(["I-X", None, "I-X", "I-X", "B", "B-", "I-", "O", "I-O"],), (None,), ([],), (["B-X", "I-Y", "I-Y"],)]
    df = spark.createDataFrame(rows, "t array<string>").coalesce(1)
    got = df.select(N.entity_spans("t").alias("a"), N.entity_spans("t", strict=True).alias("b"))
    assert "lambdafunction" not in got._jdf.queryExecution().executedPlan().toString()
    pairs = [tuple(None if x is None else [tuple(s) for s in x] for x in r) for r in got.collect()]
    assert pairs == [
        ([("X", 0, 0), ("X", 2, 3), ("", 5, 6), ("O", 8, 8)], [("", 5, 6)]), (None, None), ([], []),
        ([("X", 0, 0), ("Y", 1, 2)], [("X", 0, 0)]),
    ]


def test_entity_scores_of_odd_rows(spark):
    rows = [
        (["B-X", "I-X", "O", "B-Y"], ["B-X", "I-X", "B-Y", "B-Z"]), (None, ["B-X"]), (["B-X", None], None), ([], []),
        (["B-X", "I-X"], ["B-X"]), (["O", None, "B-Y"], ["O", None, "B-Y", "O"]),
    ]
    df = spark.createDataFrame(rows, "p array<string>, g array<string>").coalesce(1)
    scores = N.entity_scores(df, "p", "g")
    assert "lambdafunction" not in scores._jdf.queryExecution().executedPlan().toString()
    # Spans in both: X of the first row and Y of the last. Missing tags are spans of no type and equal nothing.
    r = scores.first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (2 / 5, 2 / 6, 4 / 11, 5 / 10)
