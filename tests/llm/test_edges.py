"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasheaf.llm import ann, bpe, fingerprint, jaccard, mixing, quality, tokencount, toxicity, urlfilter, warc
from datasheaf.llm.common import work_folder

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside themselves.
CLASH = ["score", "size", "node", "row", "ids", "key", "block", "held_out", "predicted", "start", "copy", "a.b"]


def documents(spark, rows):
    """Rows (doc_id, text, source) with the columns of documents and clashing ones."""
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASH})


WORDS = [f"w{i}" for i in range(300)]


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


ODD_ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", "b"), (4, "one two", None), (5, "one two", None), (5, "one two", None),
    (None, words(1, 40), "b"), (None, None, None), (7, words(2, 60_000), "a"), (8, words(1, 40), "b"), (9, "héllo 日本語 <|endoftext|> 🙂", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD_ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, None, None), (7, 1, 1), (7, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_bpe_edges(odd, none):
    got = bpe.round_trip(odd, BPE).collect()
    assert len(got) == len(ODD_ROWS)
    sha = Counter((r.doc_id, r.decoded_sha256) for r in got)
    assert sha == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ODD_ROWS)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert bpe.round_trip(none, BPE).count() == 0
    both = bpe.decode(bpe.encode(odd, BPE), BPE)
    assert both.filter("decoded <> coalesce(text, '')").count() == 0
    assert set(both.columns) == set(odd.columns) | {"decoded"}


def test_count_edges(odd, none):
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.counted(odd, BPE).collect()}
    assert (1, 0, 0, False) in got and any(i == 7 and over for i, _, _, over in got)
    assert tokencount.counted(none, BPE).count() == 0


def test_mixing_edges(odd, none):
    got = mixing.words_taken(odd).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in ODD_ROWS)
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.words_taken(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    whole = mixing.mixed_documents(odd)
    assert whole.columns == odd.columns and whole.count() > 0


def test_quality_edges(odd, none, labels):
    model = quality.fit(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.keep(odd, model).columns == odd.columns
    empty = quality.fit(none, labels.limit(0))
    assert quality.score(none, empty).count() == 0
    assert {r.score for r in quality.score(odd, empty).collect()} == {0.5}


def test_toxicity_edges(odd, none, labels):
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.keep(odd, model).columns == odd.columns
    empty = toxicity.fit(none, labels.limit(0))
    assert toxicity.score(none, empty).count() == 0
    assert toxicity.score(odd, empty).filter("predicted = 1").count() == 0


def test_fingerprint_edges(spark, odd, none):
    got = fingerprint.with_next(odd).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t, _ in ODD_ROWS)
    empty = [r for r in got if r.n_chars == 0]
    assert len({r.fingerprint for r in empty}) == 1 and all(r.near_edited == 1.0 for r in empty)
    assert fingerprint.with_next(none).count() == 0
    one = fingerprint.with_next(documents(spark, [(1, "abcdef", "a")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0


def test_jaccard_edges(odd, none):
    got = Counter((r.doc_id, r.component_id) for r in jaccard.joined(odd).collect())
    # A missing id is in the component of its copy; rows without words are alone.
    assert got == Counter([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (None, 8), (None, None), (7, 7), (8, 8), (9, 9)])
    assert jaccard.joined(none).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, None, 7, 8, 9])
    assert jaccard.one_of_each(none).count() == 0


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])


def test_nearest_edges(spark):
    bad = [(50, None), (51, [0.0, 0.0]), (52, [1.0, None]), (53, [float("nan"), 1.0]), (54, [float("inf"), 1.0]), (None, [1.0, 1.0]), (55, [])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0]), (2, [0.0, 1.0]), (100, [5.0, 5.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in bad + good], VECTORS)
    got = {(r.query_id, r.rank): (r.vec_id, round(r.score, 6)) for r in ann.nearest(df).collect()}
    assert [got[0, k][0] for k in range(1, 5)] == [1, 2, 3, 100] and (0, 5) not in got
    assert [got[100, k][0] for k in range(1, 5)] == [0, 1, 2, 3]
    assert got[0, 1][1] == 0 and got[0, 2][1] == round(2 ** 0.5, 6)
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_of_many_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0], "x") for i in range(3000)] + [(i, rng.normal(size=3).tolist(), "x") for i in range(3000, 3600)]
    df = spark.createDataFrame(rows, VECTORS)
    got = [r.vec_id for r in ann.nearest(df).filter("query_id = 100").orderBy("rank").collect()]
    assert got == list(range(10))


PAGES = "page_id long, url string, html string, key string, digest string"


def test_url_edges(spark):
    rows = [
        (1, None, "", "", ""), (2, "", "", "", ""), (3, "no scheme", "", "", ""), (4, "http://A.Example.NET/en/x?y#z", "", "", ""),
        (5, "http://b.net", "", "", ""), (6, "http://b.net/", "", "", ""), (6, "http://b.net/", "", "", ""),
        (7, "https://x.org/fr/" + "é" * 50_000, "", "", ""), (None, "http://example.com/de/", "", "", ""), (8, "http://notexample.com/de/", "", "", ""),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    got = Counter((r.page_id, r.host, r.path[:8], r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.fit(pages)).collect())
    by_id = {k[0]: k for k in got}
    assert by_id[1][1:4] == by_id[3][1:4] == ("", "", None)
    assert by_id[4] == (4, "a.example.net", "/en/x", "example.net/en/", "allow")
    assert by_id[5][1:4] == ("b.net", "", None) and got[6, "b.net", "/", "net/", "block"] == 2
    assert by_id[7][3:] == ("org/fr/", "allow") and by_id[None][3:] == ("example.com/de/", "block") and by_id[8][3] is None
    assert urlfilter.judge(pages.limit(0), urlfilter.fit(pages.limit(0))).count() == 0
    only = pages.filter("page_id = 6")
    assert {r.verdict for r in urlfilter.judge(only, urlfilter.fit(only)).collect()} == {"block"}


def test_url_suffixes_of_all_rows(spark, monkeypatch):
    urls = [f"http://h.s{i}.net/{i}" for i in range(300)] + [f"http://h.t{i}.org/fr/{i}" for i in range(300)]
    hot = min(urls, key=lambda u: hashlib.md5(u.encode()).hexdigest())
    rows = [(i, u, "", "", "") for i, u in enumerate(urls + [hot] * 400)]
    pages = spark.createDataFrame(rows, PAGES)
    model = urlfilter.fit(pages, fit_rows=60, trees=2)
    # The draw is smaller than the suffixes and than the copies of its first url.
    seen = {r.suffix: r.seen for r in model.suffixes.collect()}
    assert len(seen) == model.suffix_rows == 600 and sum(seen.values()) == 1000
    assert model.trees is not None
    sent = sorted(urlfilter.judge(pages, model).collect(), key=str)
    monkeypatch.setattr("datasheaf.llm.common.SMALL_ROWS", 10)
    assert sorted(urlfilter.judge(pages, model).collect(), key=str) == sent


def test_url_fit_takes_the_rows_it_is_given(spark, monkeypatch):
    drawn = []
    keep = lambda df, name: (drawn.append((name, df.count())), df)[1]
    monkeypatch.setattr(urlfilter, "written", keep)
    pages = spark.range(21_000).select(F.col("id").alias("page_id"), F.format_string("http://a.%s/fr/%d", F.when(F.col("id") % 2 == 0, "net").otherwise("org"), "id").alias("url"))
    urlfilter.fit(pages, fit_rows=30_000, trees=1)
    assert dict(drawn)["urls"] == 21_000


def test_warc_edges(spark):
    rows = [
        (3, "http://a.b/x", "same", "", ""), (1, "http://a.b/x", "same", "", ""), (2, None, "same", "", ""), (None, "http://a.b/y", "same", "", ""),
        (5, "", None, "", ""), (6, "http://q/\r\nX: y", "", "", ""), (7, "http://q/1", "é" * 200_000, "", ""), (7, "http://q/1", "é" * 200_000, "", ""),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_and_read(spark, pages, work_folder(spark, "t")).collect())
    assert got == Counter([
        (1, 4, "response", None), (2, 4, "revisit", 1), (3, 4, "revisit", 1), (None, 4, "revisit", 1), (5, 0, "response", None),
        (6, 0, "revisit", 5), (7, 400_000, "response", None), (7, 400_000, "response", None)])
    folder = work_folder(spark, "t")
    captures = warc.write_archives(pages, folder + "/a", least_bytes=5)
    warc.build_index(captures, folder + "/i", block_captures=2)
    one = warc.read_captures(warc.lookup(pages.filter("page_id = 1").select("url"), folder + "/i"), folder + "/a").collect()
    assert sorted((r.page_id, bytes(r.payload), r.record_type) for r in one) == [(1, b"same", "response"), (3, b"same", "response")]
    none = pages.limit(0)
    assert warc.archive_and_read(spark, none, work_folder(spark, "t")).count() == 0


def test_warc_urls_with_control_characters(spark):
    urls = ["http://a.com/x", *[f"http://a.com/x{chr(c)}y" for c in range(32)], "http://a.com/xy"]
    pages = spark.createDataFrame([(i, u, str(i), "", "") for i, u in enumerate(urls)], PAGES)
    got = warc.archive_and_read(spark, pages, work_folder(spark, "t")).collect()
    assert sorted(r.page_id for r in got) == list(range(len(urls)))


def test_warc_blocks_of_one_key_are_read_by_many_tasks(spark, monkeypatch):
    """One url in thousands of captures: its blocks are dealt out, and every capture is found."""
    folder = work_folder(spark, "hot-key")
    n = 3000
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.lit("http://a.org/x").alias("url"), F.format_string("page %d", "id").alias("html"))
    captures = warc.write_archives(pages, f"{folder}/archives")
    warc.build_index(captures, f"{folder}/index", 50)
    found = warc.lookup(pages.select("url"), f"{folder}/index").withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.page_id for r in found) == list(range(n)) and len({r.task for r in found}) > 2
