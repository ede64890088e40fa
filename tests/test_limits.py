"""Values beyond the limits that operators once had."""

import pytest
from pyspark.sql import functions as F

from datasheaf.functions.arrays import running_total
from datasheaf.operators import audit as U
from datasheaf.operators import embeddings as E
from datasheaf.operators import entities as N
from datasheaf.operators import qa as Q


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_running_total(spark, n):
    row = spark.range(1).select(running_total(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")).alias("r")).first()
    assert row.r == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_word_offsets_of_a_long_text(spark):
    words = ["ab" * (i % 4 + 1) for i in range(3000)]
    text = " ".join(words)
    got = spark.createDataFrame([(words,)], "w array<string>").select(Q.word_offsets(F.col("w")).alias("o")).first().o
    assert all(text[o.s:o.e] == w for o, w in zip(got, words, strict=True))


def test_long_entity_types_differ(spark):
    a, b = "B-" + "x" * 2000 + "1", "B-" + "x" * 2000 + "2"
    df = spark.createDataFrame([([a, "O"], [b, "O"])], "p array<string>, g array<string>")
    assert N.entity_scores(df, "p", "g").first().f1 == 0.0


def test_strict_spans(spark):
    tags = ["I-A", "I-A", "B-A", "I-A", "I-B", "I-B", "O", "B-C"]
    df = spark.createDataFrame([(tags,), ([],)], "t array<string>")
    for strict, want in ((False, [("A", 0, 1), ("A", 2, 3), ("B", 4, 5), ("C", 7, 7)]), (True, [("A", 2, 3), ("C", 7, 7)])):
        got = [[tuple(s) for s in r.s] for r in df.select(N.entity_spans("t", strict).alias("s")).collect()]
        assert got == [want, []]


def test_vectors_of_different_lengths_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "c int, v array<double>")
    with pytest.raises(ValueError, match="1 to 2"):
        E.class_centroids(df, "c", "v")


def test_blocked_prototypes_keep_rows_with_one_id(spark):
    q = spark.createDataFrame([(1, [0.0]), (1, [9.0]), (2, [5.0])], "id int, v array<double>")
    p = spark.createDataFrame([("a", [0.0]), ("b", [10.0])], "label string, proto array<double>")
    rows = lambda n: sorted((r.id, r.v, r.pred) for r in E.prototype_classify(q, "id", "v", p, inline_values=n).collect())
    assert rows(1) == rows(100) and len(rows(1)) == 3


def test_audit_looks_at_the_kept_words(spark):
    df = spark.createDataFrame([("a b => c",), ("a b c d => e",), ("a",)], "t string").withColumn("g", F.lit(1))
    r = U.token_audit(df, ["g"], "t", "=>", 4).first()
    assert (r.n, r.without_marker, r.cut) == (3, 2, 1)
