"""Language-model losses, BLEU and shifted-token accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasheaf.functions import text as T

# The largest exponent of a double, and the value reported beyond it.
MAX_EXPONENT = 709.78
OVERFLOW_PERPLEXITY = 100000.0


def perplexity(loss: str) -> Column:
    return F.exp(F.avg(loss))


def bounded_exp(mean: Column) -> Column:
    """Perplexity of a mean loss; the fixed value where it is missing, not a number or too large."""
    bad = mean.isNull() | F.isnan(mean) | (mean > MAX_EXPONENT)
    return F.when(bad, OVERFLOW_PERPLEXITY).otherwise(F.exp(mean))


def perplexity_weighted(loss: str, n: str) -> Column:
    return bounded_exp(F.sum(F.col(loss) * F.col(n)) / F.sum(n))


def length_weighted_loss(loss: str, n: str) -> Column:
    """Sum of length times loss over the number of rows minus one."""
    return F.sum(F.col(n) * F.col(loss)) / (F.count(F.lit(1)) - 1)


def mean_of_batch_means(df: DataFrame, batch: str, value: str) -> DataFrame:
    """Unweighted mean of the batch means."""
    return df.groupBy(batch).agg(F.avg(value).alias("__m")).agg(F.avg("__m").alias("mean"))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array; empty when it is shorter than n."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def corpus_bleu(df: DataFrame, id_col: str, hyp: str, ref: str, max_n: int = 4) -> DataFrame:
    """One row: clipped precisions p1..pn, brevity penalty `bp`, `bleu` (0 when a precision is 0).

    Each text's n-grams are counted on both sides in one grouping; clipping is per text.
    """
    toks = df.select(id_col, T.words(hyp).alias("h"), T.words(ref).alias("r"))

    def long(side: str) -> DataFrame:
        def tagged(n: int) -> Column:
            return F.transform(
                ngrams(F.col(side), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"))
            )

        grams = F.flatten(F.array(*[tagged(n) for n in range(1, max_n + 1)]))
        return toks.select(id_col, F.explode(grams).alias("x"), F.lit(int(side == "h")).alias("is_h"))

    both = long("h").unionByName(long("r")).groupBy(id_col, "x.n", "x.g").agg(
        F.sum("is_h").alias("h"), F.sum(1 - F.col("is_h")).alias("r")
    )
    sums = both.groupBy().agg(*[
        e for n in range(1, max_n + 1)
        for e in (
            F.sum(F.when(F.col("n") == n, F.least("h", "r"))).alias(f"m{n}"),
            F.sum(F.when(F.col("n") == n, F.col("h"))).alias(f"t{n}"),
        )
    ])
    lens = toks.agg(F.sum(F.size("h")).alias("hyp_len"), F.sum(F.size("r")).alias("ref_len"))
    hyp_len, ref_len = (lens.select(c).scalar() for c in ("hyp_len", "ref_len"))
    p = {n: F.when(F.col(f"t{n}") > 0, F.col(f"m{n}") / F.col(f"t{n}")).otherwise(0.0) for n in range(1, max_n + 1)}
    out = sums.select(*[p[n].alias(f"p{n}") for n in p], hyp_len.alias("hyp_len"), ref_len.alias("ref_len"))
    bp = F.when(F.col("hyp_len") == 0, 0.0).when(F.col("hyp_len") > F.col("ref_len"), 1.0).otherwise(
        F.exp(1 - F.col("ref_len") / F.col("hyp_len"))
    )
    logs = sum([F.ln(F.col(f"p{n}")) for n in range(2, max_n + 1)], F.ln(F.col("p1")))
    zero = F.least(*[F.col(f"p{n}") for n in p]) <= 0 if max_n > 1 else F.col("p1") <= 0
    return out.withColumn("bp", bp).withColumn(
        "bleu", F.when(zero, 0.0).otherwise(F.col("bp") * F.exp(logs / max_n))
    )


def shifted_hits(pred: Column, labels: Column, ignore: int = -100) -> tuple[Column, Column]:
    """Hits and counted positions of one row: prediction i against label i+1, ignored labels out."""
    n = F.least(F.size(pred), F.size(labels)) - 1
    pairs = F.arrays_zip(
        F.slice(pred, F.lit(1), F.greatest(n, F.lit(0))).alias("p"),
        F.slice(labels, F.lit(2), F.greatest(n, F.lit(0))).alias("y"),
    )
    used = F.filter(pairs, lambda z: z["y"] != ignore)
    hits = F.filter(used, lambda z: z["p"] == z["y"])
    return F.size(hits).cast("long"), F.size(used).cast("long")
