"""Text functions against Python's own rules."""

from pyspark.sql import functions as F

from datasheaf.functions import chat as H
from datasheaf.functions import text as T
from datasheaf.operators import chatdata as CD
from datasheaf.operators import columns as C
from datasheaf.operators import filters as W

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"
TEXTS = ["", "   ", SPACES, "a", " a b\tc\n", "x" + SPACES + "y", "é​ü 日本　語", "\x1cq\x1f", "a\x00b ﻿ z"]


def one(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", fn(F.col("t"))).collect())]


def test_words_are_pythons(spark):
    assert one(spark, TEXTS, T.words) == [t.split() for t in TEXTS]
    assert one(spark, TEXTS, T.word_count) == [len(t.split()) for t in TEXTS]
    assert one(spark, TEXTS, T.strip) == [t.strip() for t in TEXTS]
    assert one(spark, TEXTS, T.is_blank) == [not t or t.isspace() for t in TEXTS]


def test_missing_text_is_one_word(spark):
    df = spark.createDataFrame([("a b", None), (None, None)], "x string, y string")
    assert [r[0] for r in df.select(W.total_words(["x", "y"])).collect()] == [3, 2]


def test_length_band_bounds(spark):
    rows = [(i, " ".join(["w"] * n)) for i, n in enumerate([9, 10, 100, 101, 200, 201, 800, 801])]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {lv: [r["i"] for r in W.length_band(df, ["t"], lv, 10, ["i"]).orderBy("i").collect()] for lv in W.LENGTH_BANDS}
    assert got == {"easy": [1, 2], "medium": [3, 4], "hard": [5, 6]}
    assert [r["i"] for r in W.length_band(df, ["t"], "hard", 1, ["i"]).collect()] == [5]
    both = W.length_bands(df, ["t"], 1, ["i"]).collect()
    assert {(r["level"], r["i"]) for r in both} == {("easy", 1), ("medium", 3), ("hard", 5)}


def test_squad_normalize(spark):
    got = one(spark, ["The  Cat, a dog!", "an-the éa theatre", "A."], T.squad_normalize)
    assert got == ["cat dog", "anthe éa theatre", ""]


def test_paths_and_names(spark):
    assert one(spark, ["/d/cat/1.jpg", "x", "a/b.c/d"], T.parent_name) == ["cat", None, "b.c"]
    assert one(spark, ["/d/cat/1.jpg", "x"], T.last_two) == ["cat/1.jpg", "x"]
    assert one(spark, ["/d/cat/1.x.jpg", "a/b"], lambda c: T.base_name(c, ".png")) == ["1.x.png", "b.png"]
    assert one(spark, ["x" * 13, "x" * 14], T.abbreviate) == ["x" * 13, "x" * 11 + ".."]
    assert one(spark, ["a#b#c", "abc"], lambda c: T.before_marker(c, "#")) == ["a", "abc"]


def test_ids_match_whole(spark):
    df = spark.createDataFrame([([11, 23],), ([0, 1, 2],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(T.contains_ids(F.col("ids"), F.lit([1, 2]))).collect()] == [False, True, False]


def test_chat_rendering(spark):
    turns = [(1, 0, "system", " s "), (1, 1, "user", "u\n"), (1, 2, "assistant", " a "), (1, 3, "tool", "x"), (2, 0, "user", "q")]
    df = spark.createDataFrame(turns, "c int, t int, role string, content string")
    want = "\n<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\n a <|im_end|>\n"
    whole = {r["c"]: r["text"] for r in CD.render_conversations(df, "c", "t", "role", "content", part_chars=1000).collect()}
    assert whole == {1: want, 2: "\n<|im_start|>user\nq<|im_end|>\n"}
    parts = CD.render_conversations(df, "c", "t", "role", "content", part_chars=30).orderBy("c", "part").collect()
    assert "".join(r["text"] for r in parts if r["c"] == 1) == want and len(parts) > 2


def test_sql_task_messages(spark):
    df = spark.createDataFrame([("i", "t", "r")], "a string, b string, c string")
    a, b, c = (F.col(x) for x in "abc")
    m = df.select(H.sql_task_messages(a, b, c).alias("m"), H.sql_task_messages(a, b, merge_system=True).alias("n")).first()
    assert [x["role"] for x in m["m"]] == ["system", "user", "assistant"]
    assert m["m"][1]["content"] == "Task: i\nSQL table: t\nSQL query: "
    assert len(m["n"]) == 1 and m["n"][0]["content"].startswith(H.SYSTEM_PROMPT + "\nTask: i")


def test_preference_data(spark):
    msg = "array<struct<role:string,content:string>>"
    rows = [
        ([("user", "q"), ("assistant", "x")], [("user", "q"), ("assistant", "y")]),
        ([("user", "q"), ("assistant", "x")], [("user", "p"), ("assistant", "y")]),
        ([("system", "q"), ("assistant", "x")], [("system", "q"), ("assistant", "y")]),
        (None, [("user", "q")]),
        ([("user", None)], [("user", "q")]),
    ]
    df = spark.createDataFrame(rows, f"chosen {msg}, rejected {msg}")
    assert C.preference_format(df) == C.PREFERENCE_CHAT
    got = [r["violation"] for r in W.preference_violations(df).collect()]
    assert got == [None, "prompts differ", "system role", "missing side", "incomplete message"]
    p, c, r = CD.preference_from_triplet(F.lit("q"), F.lit("x"), F.lit("y"), F.lit("sys"))
    row = spark.range(1).select(p, c, r).first()
    assert row[0] == "\n<|im_start|>user\nsys\nq<|im_end|>\n" and row[1] == "\n<|im_start|>assistant\nx<|im_end|>\n"


def test_columns(spark):
    df = spark.createDataFrame([("b", "x", 1)], "q string, r string, label int")
    assert C.resolve_column(df, "question", 0) == "q" and C.resolve_sentences(df) == ("q", "r")
    assert C.rename_legacy_keys(df.withColumn("scores", F.lit(1))).columns[-1] == "objectness_logits"
    names = spark.createDataFrame([("Pos", 0), ("neg", 1)], "name string, id long")
    same = spark.createDataFrame([("POS", 5), ("NEG", 6)], "name string, id long")
    other = spark.createDataFrame([("POS", 5), ("x", 6)], "name string, id long")
    assert {tuple(r) for r in C.remap_labels(names, same).collect()} == {("Pos", 5), ("neg", 6)}
    assert {tuple(r) for r in C.remap_labels(names, other).collect()} == {("Pos", 0), ("neg", 1)}
