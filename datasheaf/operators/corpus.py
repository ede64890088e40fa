"""Word corpora: lines to positions, vocabulary, encoding, language-model batches and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from datasheaf.functions import text as T
from datasheaf.functions.arrays import running_total
from datasheaf.functions.hashing import draw, draw_int
from datasheaf.functions.runs import PLANES, joined_runs, packed_runs
from datasheaf.operators.positions import global_index, running, summed_in_order
from datasheaf.session import written

END_OF_LINE = "<eos>"


def text_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line: the kept columns, `line` (0-based) and `value`."""
    return df.select(*keep, F.posexplode(T.lines(text)).alias("line", "value"))


def nonblank_lines(df: DataFrame, text: str = "value") -> DataFrame:
    return df.filter(~T.is_blank(text))


def corpus_texts(df: DataFrame, text: str, order_by: Sequence[str]) -> DataFrame:
    """One row per text: the order columns, `lines` (the words of each line and its end marker), `n` tokens
    and `start`, the corpus position of the first one. A null text has no lines.

    The texts are put in order as they are and taken apart as they are written, with the sum of the tokens before
    them, so tokens are not shuffled and no join is needed to read them. The order columns are unique: of texts with equal ones
    each has the starts of all of them; texts with a null among them are counted and left out.
    """
    keys = [k.lstrip("-") for k in order_by]
    marked = F.transform(T.lines("__text"), lambda v: F.concat(T.words(v), F.array(F.lit(END_OF_LINE))))
    lines = F.coalesce(marked, F.array().cast("array<array<string>>")).alias("lines")
    n = F.coalesce(F.when(F.col("__text").isNotNull(), T.word_count("__text") + F.size(T.lines("__text"))), F.lit(0).cast("long"))
    own = F.col("__ds_v0_own").alias("n")
    texts = summed_in_order(df.select(*keys, F.col(text).alias("__text")), n, order_by, [*keys, lines, own], "start", compression="zstd")
    texts = texts.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    again = texts.groupBy(*keys).agg(F.collect_list("start").alias("__starts")).filter(F.size("__starts") > 1)
    again = written(again, "equal-keys")
    if again.isEmpty():
        return texts
    return texts.join(again, keys, "left").withColumn("start", F.explode(F.coalesce("__starts", F.array("start")))).drop("__starts")


def corpus_size(texts: DataFrame) -> int:
    """Tokens of all texts."""
    return texts.agg(F.max(F.col("start") + F.col("n"))).first()[0] or 0


def text_positions(texts: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """Long form of the concatenated corpus: one row per token with its line (0-based) and global `pos`."""
    ends = running_total(F.transform("lines", lambda x: F.size(x)))
    rows = texts.select(*keys, "start", F.explode(F.arrays_zip(
        F.sequence(F.lit(0), F.size("lines") - 1).alias("i"), ends.alias("end"), F.col("lines").alias("tokens"))).alias("l"))
    first = F.col("start") + F.col("l.end") - F.size("l.tokens")
    out = rows.select(*keys, F.col("l.i").alias(line), first.alias("first"), F.posexplode("l.tokens").alias("i", "token"))
    return out.select(*keys, line, (F.col("first") + F.col("i")).alias("pos"), "token")


def _pieces(texts: DataFrame, rows: int, columns: int, length: int, overlap: int) -> DataFrame:
    """`window`, `col`, `row`, `piece`: what each text contributes to stretches of `length` rows of each column.

    A stretch ends `overlap` rows into the next one. A text is cut by slices of its token array; there is a
    row for each stretch that it reaches, none for a token.
    """
    flat = texts.select("start", (F.col("start") + F.col("n") - 1).alias("end"), F.flatten("lines").alias("tokens")).filter(
        f"end >= start AND start < {rows * columns}").withColumn("end", F.least("end", F.lit(rows * columns - 1)))

    def of_column(c: Column) -> Column:
        lo = F.greatest(F.col("start") - c * rows, F.lit(0))
        hi = F.least(F.col("end") - c * rows, F.lit(rows - 1))
        first = F.greatest(F.ceil((lo - overlap + 1) / F.lit(float(length))) - 1, F.lit(0))

        def of_window(w: Column) -> Column:
            start = F.greatest(lo, w * length)
            end = F.least(hi, w * length + (length - 1 + overlap))
            at = (start + c * rows - F.col("start") + 1).cast("int")
            return F.struct(w.alias("window"), c.alias("col"), start.alias("row"),
                            F.slice("tokens", at, (end - start + 1).cast("int")).alias("piece"))

        return F.transform(F.sequence(first.cast("long"), F.floor(hi / F.lit(float(length)))), of_window)

    cols = F.sequence(F.floor(F.col("start") / F.lit(float(rows))), F.floor(F.col("end") / F.lit(float(rows))))
    return flat.select(F.explode(F.flatten(F.transform(cols, of_column))).alias("p")).select("p.*")


def _in_order(*by: str) -> Column:
    """The collected pieces of a group as one array."""
    rows = F.array_sort(F.collect_list(F.struct(*by, "piece")))
    return F.flatten(F.transform(rows, lambda s: s["piece"]))


def batch_rows(texts: DataFrame, columns: int, block: int = 1024) -> DataFrame:
    """Corpus folded into `columns` equal columns: `row` and its `tokens`, one for each column; the rest is dropped.

    Blocks of `block` rows are put together from slices of the texts and turned over inside a row.
    """
    rows = corpus_size(texts) // columns
    if not rows:
        return texts.select(F.lit(0).cast("long").alias("row"), F.array().cast("array<string>").alias("tokens")).limit(0)
    blocks = _pieces(texts, rows, columns, block, 0).groupBy("window").agg(_in_order("col", "row").alias("flat"))
    high = (F.size("flat") / columns).cast("int")

    def across(i: Column) -> Column:
        cells = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.get("flat", c * high + i))
        return F.struct((F.col("window") * block + i).alias("row"), cells.alias("tokens"))

    return blocks.select(F.explode(F.transform(F.sequence(F.lit(0), high - 1), across)).alias("r")).select("r.*")


def text_windows(texts: DataFrame, columns: int, bptt: int) -> DataFrame:
    """Windows of `bptt` rows of each of `columns` equal columns, as `bptt_windows`, put together from slices of the texts."""
    rows = corpus_size(texts) // columns
    if not rows:
        names = "window long, col long, len long, inputs array<string>, targets array<string>"
        return texts.sparkSession.createDataFrame([], names)
    return _inputs_and_targets(_pieces(texts, rows, columns, bptt, 1).groupBy("window", "col").agg(_in_order("row").alias("span")))


def build_vocab(tokens: DataFrame, token: str = "token", pos: str = "pos") -> DataFrame:
    """`token`, `id` (order of first occurrence), `n`. Counts are combined before the shuffle; the
    counted vocabulary is written once, so numbering it does not read the corpus again."""
    seen = tokens.groupBy(F.col(token).alias("token")).agg(
        F.min(pos).alias("first_pos"), F.count(F.lit(1)).alias("n")
    )
    return global_index(written(seen, "vocabulary"), "first_pos", out="id").drop("first_pos")


def first_seen_index(df: DataFrame, col: str, pos: str) -> DataFrame:
    """`col`, `id`: values numbered by first appearance."""
    return global_index(df.groupBy(col).agg(F.min(pos).alias("__first")), "__first", "id").drop("__first")


def encode(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Token rows with their `id`. The vocabulary side is unique; its size decides the join."""
    return tokens.join(vocab.select("token", "id"), "token")


# Tokens of the vocabulary that every task holds, and their greatest length.
COMMON_TOKENS, COMMON_LENGTH = 500_000, 64


def _common(vocab: DataFrame) -> DataFrame:
    """Vocabulary rows of the most frequent tokens, all that are seen equally often or none; of any tokens where counts are missing."""
    short = vocab.filter((F.length("token") <= COMMON_LENGTH) & F.col("id").isNotNull())
    if "n" in vocab.columns:
        by = Window.orderBy(F.desc("n"))  # a row for each count
        counts = short.groupBy("n").agg(F.count(F.lit(1)).alias("tokens")).withColumn("tokens", F.sum("tokens").over(by))
        least = counts.filter(F.col("tokens") <= COMMON_TOKENS).agg(F.min("n")).first()[0]
        some = short.filter(F.col("n") >= least) if least is not None else short.limit(0)
    else:
        some = short.limit(COMMON_TOKENS)
    some = F.broadcast(written(some.select("token").distinct(), "common-tokens"))
    return written(vocab.select("token", "id").join(some, "token", "left_semi"), "common-vocabulary")


def encode_sentences(
    tokens: DataFrame, vocab: DataFrame, line_keys: Sequence[str], drop_empty: bool = True
) -> DataFrame:
    """One id array per line in token order; lines that hold only the end marker are skipped.

    Common tokens, a bounded number, get their ids where they are, and leave as packed runs of consecutive
    positions of a line; only the others travel to the vocabulary as rows. Both meet on the line.
    """
    vocab = vocab.select("token", "id", *[c for c in vocab.columns if c == "n"])
    common = F.broadcast(_common(vocab))
    here = tokens.select(*line_keys, F.col("pos").cast("long").alias("pos"), "token")
    rare = vocab.select("token", F.col("id").cast("long").alias("id")).join(common.select("token"), "token", "left_anti")
    rare = written(here.join(common.select("token"), "token", "left_anti").join(rare, "token").select(*line_keys, "pos", "id"), "rare-tokens")
    ids = here.join(common.withColumn("id", F.col("id").cast("long")), "token", "left").select(*line_keys, "pos", "id")
    keys = [ids.schema[k] for k in line_keys]
    packed = StructType([*keys, *[StructField(c, LongType()) for c in ("pos", "id")], *[StructField(c, BinaryType()) for c in PLANES]])
    nothing = [F.lit(None).cast("binary").alias(c) for c in PLANES]
    pieces = ids.mapInArrow(packed_runs(line_keys), packed).unionByName(rare.select("*", *nothing))
    kind = StructType([*keys, StructField("ids", ArrayType(vocab.schema["id"].dataType))])
    out = pieces.repartition(*line_keys).sortWithinPartitions(*line_keys).mapInArrow(
        joined_runs(line_keys, to_arrow_type(kind["ids"].dataType.elementType), 1 + drop_empty), kind)
    return out


def batchify(tokens: DataFrame, total: int, columns: int) -> DataFrame:
    """Corpus folded into `columns` equal columns: `row`, `col`; the remainder is dropped."""
    n = total // columns
    return (
        tokens.filter(F.col("pos") < n * columns)
        .withColumn("row", F.col("pos") % n)
        .withColumn("col", F.floor(F.col("pos") / n))
    )


def bptt_windows(cells: DataFrame, bptt: int, token: str = "token") -> DataFrame:
    """Windows of `bptt` rows per column with the inputs and the targets one row later.

    A row on a window boundary is the last target of the window before it, so it is emitted twice;
    no neighbour lookup is needed. The last window may be short.
    """
    w = F.floor(F.col("row") / bptt)
    here = F.struct(w.alias("window"), (F.col("row") % bptt).alias("off"))
    ends = F.struct((w - 1).alias("window"), F.lit(bptt).cast("long").alias("off"))
    boundary = (F.col("row") % bptt == 0) & (F.col("row") > 0)
    member = F.explode(F.when(boundary, F.array(here, ends)).otherwise(F.array(here)))
    spans = (
        cells.select("col", F.col(token).alias("token"), member.alias("m"))
        .groupBy(F.col("m.window").alias("window"), "col")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("m.off").alias("off"), "token"))),
                lambda s: s["token"],
            ).alias("span")
        )
    )
    return _inputs_and_targets(spans)


def _inputs_and_targets(spans: DataFrame) -> DataFrame:
    return spans.filter(F.size("span") > 1).select(
        "window", "col",
        (F.size("span") - 1).cast("long").alias("len"),
        F.expr("slice(span, 1, size(span) - 1)").alias("inputs"),
        F.expr("slice(span, 2, size(span) - 1)").alias("targets"),
    )


def _normal(seed: int | str, i: Column) -> Column:
    u1 = (draw_int(f"{seed}:u1", i) + 1) / F.lit(float(2**32))
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * F.pi() * draw(f"{seed}:u2", i))


def random_windows(
    spark, rows: int, bptt: int, max_delta: int, seed: int = 0, fixed: bool = False
) -> DataFrame:
    """`window`, `start`, `len` of windows with drawn lengths over `rows` rows.

    Length i: base bptt (95%) or half of it, normal(base, 5) cut to an integer, at least 5, at most
    bptt + max_delta; `fixed` uses bptt. Starts are prefix sums of the lengths drawn for an upper
    bound of windows; the list ends where the data does.
    """
    last = rows - 2
    least = bptt if fixed else 5
    idx = spark.range(max(0, -(-last // least))).withColumnRenamed("id", "window")
    if fixed:
        drawn = F.lit(bptt).cast("long")
    else:
        base = F.when(draw(f"{seed}:base", "window") < 0.95, float(bptt)).otherwise(bptt / 2.0)
        n = (base + 5.0 * _normal(seed, F.col("window"))).cast("long")
        drawn = F.least(F.greatest(n, F.lit(5)), F.lit(bptt + max_delta))
    lens = idx.withColumn("drawn", drawn)
    starts = running(lens, F.col("drawn"), "window", inclusive=False, out="start")
    return starts.select(
        "window", F.col("start").cast("long").alias("start"),
        F.least(F.col("drawn"), F.lit(last - 1) - F.col("start")).cast("long").alias("len"),
    ).filter(F.col("len") > 0)
