"""Corpora: what their tokens are joined by, and encoded lines against joins of token rows."""

import glob
import random
import time

import pytest
from pyspark.sql import functions as F

from datasheaf.operators import corpus as C
from datasheaf.session import written

KEYS = ["doc", "line"]


def _by_joins(tokens, vocab):
    rows = tokens.join(vocab.select("token", "id"), "token").groupBy(*KEYS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("ids"))
    return sorted(map(repr, rows.collect()))


def _tokens(spark, seed):
    """Lines in order and rows at random, repeated positions, nulls in every column."""
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(600)] + ["x" * 300, None, "not in the vocabulary"]
    rows, pos = [], 0
    for doc in [*"abcdef", None]:
        for line in [*range(rng.randrange(1, 6)), *rng.choice([[], [None]])]:
            for _ in range(rng.randrange(60)):
                rows.append((doc, line, pos if rng.random() < 0.99 else rng.choice([None, 3]), rng.choice(words)))
                pos += 1
    rows += rng.sample(rows, 30)
    vocab = [(w, i * 2**rng.choice([0, 8, 20, 40]), rng.randrange(1, 9)) for i, w in enumerate(sorted({w for w in words if w} - {"not in the vocabulary"}))]
    vocab += [(vocab[3][0], 77, 1), (vocab[9][0], 78, 9), (vocab[0][0], -5, 3)]
    return (spark.createDataFrame(rows, "doc string, line int, pos long, token string"),
            spark.createDataFrame(vocab, "token string, id long, n long"))


@pytest.mark.parametrize(("seed", "common"), [(1, 60), (2, 0), (3, 500_000)])
def test_encoded_lines_are_those_of_joined_tokens(spark, monkeypatch, seed, common):
    tokens, vocab = _tokens(spark, seed)
    monkeypatch.setattr(C, "COMMON_TOKENS", common)
    want = _by_joins(tokens, vocab)
    assert sorted(map(repr, C.encode_sentences(tokens, vocab, KEYS, drop_empty=False).collect())) == want and len(want) > 15
    if common == 60:
        more = C.encode_sentences(tokens, vocab.drop("n"), KEYS)
        assert sorted(map(repr, more.collect())) == [r for r in want if r.split("ids=")[1].count(",") > 0]


def test_starts_of_texts_with_equal_or_missing_keys(spark):
    rows = [(5, "a b\nc"), (2, "g"), (3, None), (2, "d"), (None, "e f"), (7, "")]
    got = sorted((r.k, r.start, r.n, r.lines) for r in C.corpus_texts(spark.createDataFrame(rows, "k int, t string"), "t", ["k"]).collect())
    twice = [(2, start, 2, [[w, "<eos>"]]) for start in (3, 5) for w in "dg"]  # after the text without a key
    assert got == [*twice, (3, 7, 0, []), (5, 7, 5, [["a", "b", "<eos>"], ["c", "<eos>"]]), (7, 12, 1, [["<eos>"]])]


def test_tokens_are_not_shuffled_for_their_places_or_ids(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = C.corpus_texts(spark.createDataFrame([(i, "a b\nc a") for i in range(50)], "doc int, t string"), "t", ["doc"])
        tokens = C.text_positions(texts, ["doc"])
        rows = C.encode_sentences(tokens, C.build_vocab(tokens), KEYS)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (texts, rows)]
        assert [p.count("SortMergeJoin") for p in plans] == [0, 0] and [p.count("hashpartitioning(doc") for p in plans] == [0, 1]
        assert sorted(r.ids for r in rows.collect()) == sorted([[0, 1, 2], [3, 0, 2]] * 50)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tables_leave_no_shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = files()
    written(spark.range(1000).repartition(3, "id"), "t")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
