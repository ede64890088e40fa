"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots. Slot i is the van der Corput point of i; the point falls in the share
of one source, and the k-th slot of a source takes the k-th block of that source's shuffled words.
The points are the integers below the number of slots with their bits reversed, so each source gets
exactly its quota of slots and any stretch of the mix is close to the target weights.

Only DataFrame functions are used. Nothing is ordered in one task: running sums go over buckets of a
source's shuffled documents, and a slot's rank within its source has a closed form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datasheaf.llm.common import sent_if_small, spread_count, written

WORD = r"[^\x20\x09-\x0D]+"
# Words of a block, documents of a bucket, and the most buckets that one source is cut into.
BLOCK_WORDS = 256
BUCKET_ROWS = 256
MAX_BUCKETS = 1 << 16
CELL = 1 << 14


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, size: Column, seed: str = "mix") -> Column:
    """Order of the documents of one source: md5 of seed, id and size."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string")))


def source_targets(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: rank, documents, source_size, weight and target.

    Sources are ranked by code point, null last, and take the weights in turn. The total is `share` of
    all words. A target stops at `cap` times the source's size; what is above goes to the others by
    weight. Sorted by cap / weight, the stopped sources come first, so one pass finds the level.
    """
    s = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = s.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(w, ((F.col("src") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("ceiling", F.col("source_size") * F.lit(float(cap)))
    by = Window.orderBy(F.col("ceiling") / F.col("weight"), "src")
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    zero = F.lit(0.0)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("weights", F.sum("weight").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("ceiling").over(before), zero)) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(before), zero))
    s = s.withColumn("stopped", F.col("weight") * level >= F.col("ceiling"))
    kept = lambda c: F.sum(F.when(F.col("stopped"), F.col(c)).otherwise(zero)).over(everything)
    left = F.col("weights") - kept("weight")
    last = F.when(left > 0, (F.col("total") - kept("ceiling")) / left)
    s = s.withColumn("level", last)
    target = F.when(F.col("stopped"), F.col("ceiling")).otherwise(F.col("weight") * F.col("level"))
    return s.select("source", "src", "docs", "source_size", "weight", target.alias("target"))


def bits_reversed(value: Column, bits: int) -> Column:
    """The lowest `bits` bits of a number in reverse order."""
    if bits == 0:
        return F.lit(0).cast("long")
    return F.conv(F.reverse(F.lpad(F.bin(value), bits, "0")), 2, 10).cast("long")


def residues(limit: Column, bits: int) -> Column:
    """Classes (power, residue) whose members are the numbers with reversed bits below `limit`."""
    text = F.lpad(F.bin(limit), bits + 1, "0")
    ones = F.filter(F.sequence(F.lit(0), F.lit(bits)), lambda k: F.substr(text, k + 1, F.lit(1)) == "1")
    upper = lambda k: F.reverse(F.substr(text, F.lit(2), k - 1))
    return F.transform(ones, lambda k: F.struct(
        k.alias("power"),
        F.when(k > 1, F.conv(upper(k), 2, 10).cast("long")).otherwise(F.lit(0).cast("long")).alias("residue")))


def members_below(number: Column, classes: Column) -> Column:
    """How many numbers below `number` lie in the classes."""
    def one(acc: Column, c: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), c["power"])
        return acc + F.call_function("shiftright", number + size - 1 - c["residue"], c["power"])
    return F.aggregate(classes, F.lit(0).cast("long"), one)


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of every row; other columns are left out."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of `docs` (doc_id, text, source): sized documents, sources with targets, and the pieces.

    A piece is (slot, src, block, doc_id, size, start, pass, from_word, to_word): slot is its place in
    the mix, start the document's first word within its source's shuffled words. Pass 1 is the first
    repetition. Documents without words have no piece; a missing source is a source; repeated rows are
    documents of their own; rows that tie in id and size are interchangeable. An empty table gives none.
    """
    spark = docs.sparkSession
    sized = written(sized_documents(docs), "mix-sizes")
    sources = source_targets(sized, weights, share, cap)
    words = F.floor("target").cast("long")
    quota = F.ceil(words / block_words).cast("long")
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    sources = sources.withColumn("words", words).withColumn("quota", quota)
    sources = written(sources.withColumn("last", F.sum("quota").over(upto)), "mix-sources")
    n_sources, slots = sources.agg(F.count("*"), F.max("last")).first()
    bits = max((slots or 0) - 1, 0).bit_length()

    # Where each document begins within its source's shuffled words.
    some = sized.filter("size > 0").withColumn("ord", shuffle_key(F.col("doc_id"), F.col("size")))
    slim = sources.select(F.col("source").alias("of"), "src", "docs", "source_size", "words")
    some = some.join(sent_if_small(slim, n_sources), F.col("source").eqNullSafe(F.col("of")))
    buckets = F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("docs") / BUCKET_ROWS))
    place = F.conv(F.substring("ord", 1, 8), 16, 10).cast("long")
    some = some.withColumn("bucket", F.floor(place * buckets / F.lit(float(1 << 32))).cast("long"))
    some = some.select("src", "bucket", "ord", "doc_id", "size", "source_size", "words")
    sums = some.groupBy("src", "bucket").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "bucket", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "bucket").orderBy("ord", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    some = some.withColumn("upto", F.sum("size").over(inside)).join(sums, ["src", "bucket"])
    some = some.withColumn("start", F.col("base") + F.col("upto") - F.col("size"))

    # Cut the words that are taken, pass by pass, at the block bounds.
    passes = F.floor((F.col("words") - 1 - F.col("start")) / F.col("source_size"))
    some = some.filter(F.col("start") < F.col("words"))
    some = some.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), passes.cast("long"))))
    some = some.withColumn("first", F.col("start") + F.col("pass") * F.col("source_size"))
    some = some.withColumn("end", F.least(F.col("first") + F.col("size"), F.col("words")))
    at = lambda c: F.floor(c / block_words).cast("long")
    some = some.withColumn("block", F.explode(F.sequence(at(F.col("first")), at(F.col("end") - 1))))
    lo, hi = F.col("block") * block_words, (F.col("block") + 1) * block_words
    pieces = some.select(
        "src", "block", "doc_id", "size", "start", "pass",
        (F.greatest("first", lo) - F.col("first")).alias("from_word"),
        (F.least("end", hi) - F.col("first")).alias("to_word"))

    # Points of each source's share, their slots, and the slots' ranks within the source.
    owned = sources.filter("quota > 0").select(
        "src", "quota", (F.col("last") - F.col("quota")).alias("low"),
        residues(F.col("last") - F.col("quota"), bits).alias("below"), residues(F.col("last"), bits).alias("within"))
    cells = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / CELL).cast("long")))
    points = owned.withColumn("cell", cells).repartition(spread_count(spark), "src", "cell")
    ends = F.least(F.col("quota"), (F.col("cell") + 1) * CELL) - 1
    points = points.withColumn("point", F.explode(F.sequence(F.col("low") + F.col("cell") * CELL, F.col("low") + ends)))
    points = points.withColumn("slot", bits_reversed(F.col("point"), bits))
    rank = members_below(F.col("slot"), F.col("within")) - members_below(F.col("slot"), F.col("below"))
    schedule = points.select("src", rank.alias("block"), "slot")
    # The slots come from a few rows, so their number is not seen in the size of an exchange: never broadcast.
    return sized, sources, schedule.hint("merge").join(pieces.hint("merge"), ["src", "block"])


def words_taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document. Null and empty texts take no words."""
    sized, sources, pieces = mix(docs, **how)
    taken = pieces.groupBy("src", "doc_id", "size", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    n_sources = sources.count()
    facts = sent_if_small(sources.select("src", "source", "source_size", "target", "words"), n_sources)
    got = taken.join(facts, "src").select("doc_id", "size", "source_size", "target", "taken")
    # Documents that the mix leaves out: those without words, and those beyond their source's target.
    rows = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    with_piece = taken.groupBy("src", "doc_id", "size").agg(F.count("*").alias("m")).join(
        facts.select("src", F.col("source").alias("of")), "src").withColumnsRenamed({"doc_id": "id", "size": "words_of"})
    rest = rows.join(
        with_piece,
        F.col("source").eqNullSafe(F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("size") == F.col("words_of")),
        "left",
    ).withColumn("left_out", F.col("n") - F.coalesce("m", F.lit(0))).filter("left_out > 0")
    rest = rest.select("source", "doc_id", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left_out"))).alias("copy"))
    named = facts.withColumnRenamed("source", "of")
    rest = rest.join(named, F.col("source").eqNullSafe(F.col("of")))
    return got.unionByName(rest.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """Whole documents of the mix, with the columns of `docs`: one row for each time its first word is taken."""
    _, sources, pieces = mix(docs, **how)
    facts = sent_if_small(sources.select("src", F.col("source").alias("of")), sources.count())
    times = pieces.filter("from_word = 0").groupBy("src", "doc_id", "size", "start").agg(F.count("*").alias("times"))
    same = Window.partitionBy("of", "doc_id", "size")
    times = times.join(facts, "src").select(
        "of", F.col("doc_id").alias("id"), F.col("size").alias("words_of"), "times",
        F.row_number().over(same.orderBy("start")).alias("k"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.source").alias("source"), F.col("row.doc_id").alias("doc_id"), word_count(F.col("row.text")).alias("size"))
    nth = F.row_number().over(Window.partitionBy("source", "doc_id", "size").orderBy("row.text"))
    rows = rows.filter("size > 0").withColumn("nth", nth)
    both = rows.join(
        times,
        F.col("source").eqNullSafe(F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))
        & (F.col("size") == F.col("words_of")) & (F.col("nth") == F.col("k")),
    )
    out = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select("row.*")
