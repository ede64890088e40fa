"""Toxicity by weak supervision.

Many voters look at a text: words and word beginnings of a lexicon, and patterns. A generative model of
two classes estimates each voter's accuracy from the votes alone, and from what is left over after it
the correlations of voters, which lower the say of voters that repeat each other. Its posteriors are the
labels of a linear classifier on terms, which scores all texts. The lexicon is a short fixed list plus
terms mined from labelled rows that are not held out. Mining and fit take a bounded draw of rows
(`toxic_rows`, `clean_rows`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasheaf.llm.common import drawn, held_out, kept_by_text, texts_of, written
from datasheaf.llm.quality import descend, sigmoid

TOXIC_ROWS, CLEAN_ROWS = 3000, 6000
VOTERS, TERMS = 120, 600
THRESHOLD = 0.5
WORD = re.compile(r"[^\W_]+")
# Common insults.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown",
           "dumb", "jerk", "ugly", "fool", "filth", "vermin")
PATTERNS = ("many_insults", "insult_shouted", "you_are")
YOU_ARE = re.compile(r"\byou(?:'re| are)\s+(?:an?\s+|such\s+)?(?:" + "|".join(INSULTS) + r")\b", re.I)
SHOUTED = re.compile(r"\b(?:" + "|".join(x.upper() for x in INSULTS) + r")\b")


def terms(text: str) -> set[str]:
    """Lower-cased words, and beginnings of four and five letters, marked by a leading `^`."""
    words = set(WORD.findall(text.lower()))
    return words | {"^" + w[:4] for w in words if len(w) > 4} | {"^" + w[:5] for w in words if len(w) > 5}


def patterns(text: str, found: set[str]) -> list[bool]:
    insults = sum(x in found for x in INSULTS)
    return [insults > 1, insults > 0 and bool(SHOUTED.search(text)), insults > 0 and bool(YOU_ARE.search(text))]


@dataclass
class LabelModel:
    """Two classes; `fires` holds each voter's rate among clean and among toxic texts."""

    prior: float
    fires: np.ndarray
    discount: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.fires[1] / self.fires[0]) * self.discount
        off = np.log((1 - self.fires[1]) / (1 - self.fires[0])) * self.discount
        return sigmoid(np.log(self.prior / (1 - self.prior)) + votes @ on + (1 - votes) @ off)


def label_model(votes: np.ndarray, prior: float = 0.1, rounds: int = 4, steps: int = 15) -> LabelModel:
    """Accuracies by expectation-maximisation, correlations from what the two classes leave unexplained.

    A voter that moves with k others, counted by the square of their correlation within a class where
    that is strong, says 1 / (1 + k) of what it would say alone.
    """
    n, m = votes.shape
    fires = np.vstack([np.full(m, 0.01), np.full(m, 0.3)])
    model = LabelModel(prior, fires, np.ones(m))
    belief = np.where(votes.any(1), 0.9, 0.02)
    for _ in range(rounds):
        for _ in range(steps):
            # Beta priors keep rates off 0 and 1 and a voter from turning round.
            toxic, clean = belief.sum(), n - belief.sum()
            model.fires = np.vstack([(votes.T @ (1 - belief) + 0.1) / (clean + 10), (votes.T @ belief + 0.5) / (toxic + 5)])
            model.fires = np.clip(model.fires, 1e-5, 1 - 1e-5)
            model.fires[1] = np.maximum(model.fires[1], model.fires[0])
            model.prior = float(np.clip((toxic + 1) / (n + 10), 1e-3, 0.5))
            belief = model.posterior(votes)
        spread = np.zeros((m, m))
        for c, weight in ((0, 1 - belief), (1, belief)):
            left = votes - model.fires[c]
            cov = (left * weight[:, None]).T @ left / max(weight.sum(), 1.0)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            spread = np.maximum(spread, np.abs(cov / np.outer(sd, sd)) * (weight.sum() > 20))
        np.fill_diagonal(spread, 0)
        model.discount = 1 / (1 + np.where(spread > 0.6, spread ** 2, 0).sum(1))
        belief = model.posterior(votes)
    return model


@dataclass
class ToxicModel:
    """Weights of terms and patterns; without any the score is `bias` alone."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    pattern_weights: tuple[float, ...] = (0.0,) * len(PATTERNS)

    def score(self, text: str) -> float:
        found = terms(text)
        hits = found & self.weights.keys()
        z = self.bias + sum(self.weights[t] for t in sorted(hits))
        if not hits.isdisjoint(INSULTS):
            z += sum(w for w, on in zip(self.pattern_weights, patterns(text, found), strict=True) if on)
        return float(sigmoid(np.array(z)))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> ToxicModel:
    """Model from at most `toxic_rows` and `clean_rows` labelled texts, none of them held out.

    Ids with contradicting labels count as clean. Without toxic labels, only the fixed list is looked for.
    """
    known = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    ids = drawn(known.filter("toxic = 1"), "toxic", toxic_rows).withColumn("toxic", F.lit(1)).unionByName(
        drawn(known.filter("toxic = 0"), "clean", clean_rows).withColumn("toxic", F.lit(0)))
    sample = written(texts_of(docs, ids), "toxic-sample")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b["toxic"], pa.array([sorted(terms(t)) for t in b["text"].to_pylist()], pa.list_(pa.string()))], ["toxic", "terms"])

    by_term = sample.select("toxic", "text").mapInArrow(listed, "toxic int, terms array<string>")
    by_term = by_term.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_toxic, n_clean = n[0], n[1] - n[0]
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1) / ((F.col("c") + 0.5) / (n_clean + 1)))
    mined = by_term.filter("t >= 3").withColumn("gain", F.col("t") * odds).filter("gain > 0")
    mined = [(r["term"], r["t"], r["c"]) for r in mined.orderBy(F.desc("gain"), "term").limit(TERMS).collect()]
    # Voters must be precise; the classifier may use the other terms as well.
    precise = [t for t, on, off in mined if (on + 0.5) / (n_toxic + 1) > 20 * (off + 0.5) / (n_clean + 1)]
    vocabulary = list(dict.fromkeys([*INSULTS, *precise[:VOTERS], *(t for t, _, _ in mined)]))
    voters = len(set(INSULTS) | set(precise[:VOTERS]))
    place = {t: i for i, t in enumerate(vocabulary)}

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b["text"].to_pylist():
                x, found = np.zeros(len(place) + len(PATTERNS), np.uint8), terms(text)
                x[[place[t] for t in found & place.keys()]] = 1
                x[len(place):] = patterns(text, found)
                rows.append(np.packbits(x).tobytes())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(rows, pa.binary())], ["doc_id", "x"])

    got = sample.select("doc_id", "text").mapInArrow(voted, "doc_id long, x binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("x", "ascending")])["x"].to_pylist()
    wide = len(vocabulary) + len(PATTERNS)
    if not got:
        return ToxicModel(-3.0, {t: 6.0 for t in INSULTS})
    x = np.vstack([np.unpackbits(np.frombuffer(r, np.uint8))[:wide] for r in got]).astype(float)
    votes = np.c_[x[:, :voters], x[:, len(vocabulary):]]
    q = label_model(votes).posterior(votes)
    a = np.c_[x, np.ones(len(x))]
    balance = np.where(q > 0.5, 0.5 / max(q.mean(), 1e-3), 1.0)
    def gradient(w: np.ndarray) -> np.ndarray:
        return a.T @ ((sigmoid(a @ w) - q) * balance) / len(a) + np.r_[3e-4 * w[:-1], 0.0]
    w = descend(gradient, a.shape[1], 400, 0.1)
    weights = dict(zip(vocabulary, w.tolist(), strict=False))
    return ToxicModel(float(w[-1]), weights, tuple(w[len(vocabulary):-1].tolist()))


def score(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null and empty texts are scored as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s, pa.float64())], ["doc_id", "score"])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` below the threshold, columns unchanged."""
    return kept_by_text(docs, lambda texts: [model.score(t) < threshold for t in texts])
