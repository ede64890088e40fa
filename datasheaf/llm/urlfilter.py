"""URL verdicts: rules first, then gradient-boosted trees on lexical features.

The trees learn from URLs that a rule decides. Everything is DataFrame functions and Spark's own
GBTClassifier. The fit takes at most `fit_rows` distinct labelled URLs (those with the smallest md5);
suffixes are counted over all labelled rows, and every URL is judged.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasheaf.llm.common import sent_if_small, written

# (verdict, host, path)
RULES = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)
FIT_ROWS = 20_000
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "params",
    "query_length", "hyphens", "secure", "fragment", "suffix_seen", "suffix_blocked",
)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits a host or its parent domain and a path's start."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character, from runs of the sorted characters; 0 for an empty text."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(chars).cast("double")
    weigh = lambda k: F.when(k > 0, k * F.log2(F.greatest(k, F.lit(1.0)))).otherwise(F.lit(0.0))
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    def step(acc: Column, c: Column) -> Column:
        same = acc["last"] == c
        return F.struct(
            c.alias("last"), F.when(same, acc["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"),
            F.when(same, acc["sum"]).otherwise(acc["sum"] + weigh(acc["run"])).alias("sum"))
    total = F.aggregate(chars, start, step, lambda acc: acc["sum"] + weigh(acc["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(F.lit(0.0))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    length = F.length(u).cast("double")
    return {
        "url_length": length, "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": count(path, "/[^/]"), "labels": count(host, r"\."),
        "digit_ratio": count(u, "[0-9]") / F.greatest(length, F.lit(1.0)), "entropy": entropy(u),
        "params": count(query, "[^&]+"), "query_length": F.length(query).cast("double"), "hyphens": count(host, "-"),
        "secure": F.startswith(u, F.lit("https:")).cast("double"), "fragment": F.contains(u, F.lit("#")).cast("double"),
    }


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def lexical_frame(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    base = pages.select(F.col("page_id"), F.col("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    base = base.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    feats = lexical(F.col("url"), F.col("host"), F.col("path"))
    return base.select("page_id", "url", "host", "path", "hit", suffix_of(F.col("host")).alias("suffix"), *[c.alias(n) for n, c in feats.items()])


@dataclass
class UrlModel:
    """Boosted trees with the table of all labelled suffixes; without trees, one verdict for all."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    suffix_rows: int
    otherwise: str


def with_suffixes(df: DataFrame, suffixes: DataFrame, suffix_rows: int) -> DataFrame:
    df = df.join(sent_if_small(suffixes, suffix_rows), "suffix", "left")
    return df.withColumns({
        "suffix_seen": F.log1p(F.coalesce("seen", F.lit(0)).cast("double")),
        "suffix_blocked": F.coalesce("rate", F.lit(0.5)),
    })


def assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def fit(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, fit_rows: int = FIT_ROWS,
    trees: int = 12, depth: int = 4, seed: int = 7,
) -> UrlModel:
    """Boosted trees from the URLs that a rule decides.

    With one verdict only among them, that one holds for all; without any, `allow`.
    """
    known = lexical_frame(pages.filter("url is not null").select("page_id", "url"), rules).filter("hit is not null")
    known = known.withColumn("label", (F.col("hit.verdict") == "block").cast("double")).select("url", "suffix", "label")
    suffixes = known.groupBy("suffix").agg(
        F.count("*").alias("seen"), F.sum("label").alias("blocked"), ((F.sum("label") + 1) / (F.count("*") + 2)).alias("rate"))
    suffixes = written(suffixes, "url-suffixes")
    found = suffixes.agg(F.count("*").alias("rows"), F.sum("seen").alias("seen"), F.sum("blocked").alias("blocked")).first()
    seen, blocked = found["seen"] or 0, int(found["blocked"] or 0)
    if blocked in (0, seen):
        return UrlModel(None, None, 0, "block" if blocked else "allow")
    # Both verdicts are drawn, the rarer by its share of the rows or a twentieth of the draw.
    rarer, rare = min((blocked, 1.0), (seen - blocked, 0.0))
    few = min(rarer, max(fit_rows * rarer // seen, fit_rows // 20, 1))
    one = lambda label, n: known.filter(F.col("label") == label).select("url").distinct().orderBy(F.md5("url"), "url").limit(n)
    urls = one(rare, few).unionByName(one(1 - rare, max(fit_rows - few, 1)))
    data = lexical_frame(urls.withColumn("page_id", F.lit(0)), rules)
    data = written(data.withColumn("label", (F.col("hit.verdict") == "block").cast("double")).drop("hit").repartition(4), "urls")
    data = assembled(with_suffixes(data, suffixes, found["rows"])).select("features", "label")
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=32, stepSize=0.3)
    return UrlModel(gbt.fit(data), suffixes, found["rows"], "allow")


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of every page.

    The longest fitting rule decides; without one the trees do (block from 0.5 up). A url that is null
    or lacks `://` has an empty host and path and goes to the trees. Repeated rows are judged alike.
    """
    df = lexical_frame(pages, rules)
    if model.trees is None:
        df = df.withColumn("block_score", F.lit(1.0 if model.otherwise == "block" else 0.0))
    else:
        df = model.trees.transform(assembled(with_suffixes(df, model.suffixes, model.suffix_rows)))
        df = df.withColumn("block_score", vector_to_array("probability")[1])
    learned = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return df.select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), learned).alias("verdict"), "block_score")
