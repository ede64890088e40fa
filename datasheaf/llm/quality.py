"""Quality by positive-unlabelled learning.

Trusted positives and unlabelled texts train a logistic model on the shape of texts: how character
classes follow each other, how long words are, how much is repeated. The risk is the non-negative
unbiased estimate; the class prior comes from the best bin of a positive-against-unlabelled ranking.
Labels enter the fit only as the list of trusted positives. The fit takes bounded draws of rows
(`positives` and `unlabelled`); everything else covers all rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasheaf.llm.common import drawn, held_out, kept_by_text, texts_of

POSITIVES, UNLABELLED = 6000, 6000
THRESHOLD = 0.3
CLASSES = ("end", "lower", "upper", "letter", "digit", "space", "line", "stop", "comma", "shout", "bar", "symbol", "other")
N = len(CLASSES)


def class_table() -> np.ndarray:
    """Class of every code point of the basic plane."""
    table = np.full(1 << 16, CLASSES.index("other"), np.uint8)
    by_category = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Lm": "letter", "Lo": "letter", "Nd": "digit",
                   "Zs": "space", "Po": "symbol", "Sc": "symbol", "Sm": "symbol", "Sk": "symbol", "So": "symbol"}
    for c in range(1 << 16):
        kind = by_category.get(unicodedata.category(chr(c)))
        if kind:
            table[c] = CLASSES.index(kind)
    for chars, kind in ((" \t", "space"), ("\n\r", "line"), (".?", "stop"), (",;:'\"()-", "comma"), ("!", "shout"), ("|", "bar")):
        for ch in chars:
            table[ord(ch)] = CLASSES.index(kind)
    return table


def repetition(text: str) -> list[float]:
    words = text.split()
    if not words:
        return [0.0, 0.0, 0.0, 0.0, 0.0]
    lines = [x for x in text.split("\n") if x]
    n = len(words)
    twins = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    return [np.log1p(n), len(text) / n, len(set(words)) / n, twins, 1 - len(set(lines)) / max(len(lines), 1)]


def shape(texts: list[str], table: np.ndarray) -> np.ndarray:
    """One row of features per text: shares of class pairs, then measures of repetition."""
    out = np.zeros((len(texts), N * N + 5), np.float32)
    for i, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        k = table[np.minimum(codes, 0xFFFF)]
        if k.size > 1:
            out[i, :N * N] = np.bincount(k[:-1].astype(np.intp) * N + k[1:], minlength=N * N) / (k.size - 1)
        out[i, N * N:] = repetition(t)
    return out


@dataclass
class QualityModel:
    """Weights on standardised features, and the estimated prior; without weights the prior is every score."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled: the smallest ratio of the two tails of a score.

    Each tail carries its confidence bound, so that thin tails are not chosen.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.99, 100)))
    tail = lambda s: 1 - np.searchsorted(np.sort(s), cuts, "left") / len(s)
    bound = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    p, u = tail(positive), tail(unlabelled)
    best = int(np.argmin((u + bound) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.01, 0.99))


def non_negative_risk(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int, ridge: float) -> np.ndarray:
    """Weights (bias last) at a small non-negative risk with logistic loss."""
    ap, au = (np.c_[x, np.ones(len(x), x.dtype)] for x in (xp, xu))
    softplus = lambda z: np.logaddexp(0, z)
    def gradient(w: np.ndarray) -> np.ndarray:
        w32 = w.astype(ap.dtype)
        zp, zu = ap @ w32, au @ w32
        as_negative_u = au.T @ sigmoid(zu) / len(au)
        as_negative_p = prior * (ap.T @ sigmoid(zp)) / len(ap)
        negative = softplus(zu).mean() - prior * softplus(zp).mean()
        keep = np.r_[ridge * w[:-1], 0.0]
        if negative < 0:
            return as_negative_p - as_negative_u + keep
        return prior * (ap.T @ (sigmoid(zp) - 1)) / len(ap) + as_negative_u - as_negative_p + keep
    return descend(gradient, ap.shape[1], steps, 0.05)


def fit_arrays(xp: np.ndarray, xu: np.ndarray, steps: int = 500, ridge: float = 1e-3) -> QualityModel:
    """Model from features of trusted positives and of unlabelled texts."""
    if not len(xp) or not len(xu):
        return QualityModel(0.5)
    mean, scale = xu.mean(0), xu.std(0) + 1e-4
    zp, zu = np.clip((xp - mean) / scale, -6, 6), np.clip((xu - mean) / scale, -6, 6)
    zp, zu = zp.astype(np.float32), zu.astype(np.float32)
    # The prior is read off rankings that half of each set trained and the other half judges. Each of
    # them bounds it from above, so the smallest counts.
    prior = 0.99
    for split in range(4):
        half = np.random.default_rng(split)
        p, u = half.random(len(zp)) < 0.5, half.random(len(zu)) < 0.5
        if min(p.sum(), u.sum(), (~p).sum(), (~u).sum()):
            w = non_negative_risk(zp[p], zu[u], 0.5, steps // 3, ridge)
            prior = min(prior, best_bin_prior(zp[~p] @ w[:-1], zu[~u] @ w[:-1]))
    w = non_negative_risk(zp, zu, prior, steps, ridge)
    return QualityModel(prior, mean, scale, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> QualityModel:
    """Model from at most `positives` trusted and `unlabelled` other texts, none of them held out.

    An id whose labels contradict each other is not trusted. Without positives the score is 0.5.
    """
    known = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("q"))
    p = drawn(known.filter("q = 1"), "trusted", positives).withColumn("trusted", F.lit(1))
    u = drawn(docs.select("doc_id").filter(~held_out(F.col("doc_id"))), "web", unlabelled).withColumn("trusted", F.lit(0))
    rows = texts_of(docs, p.unionByName(u))
    table = class_table()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = shape(b["text"].to_pylist(), table)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["trusted"], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "trusted", "x"])
    got = rows.select("doc_id", "trusted", "text").mapInArrow(run, "doc_id long, trusted int, x binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(got.num_rows, N * N + 5).astype(float)
    trusted = got["trusted"].to_numpy() == 1
    return fit_arrays(x[trusted], x[~trusted])


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null and empty texts are scored as empty."""
    table = class_table()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(shape(b["text"].to_pylist(), table))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s, pa.float64())], ["doc_id", "score"])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` at or above the threshold, columns unchanged."""
    table = class_table()
    return kept_by_text(docs, lambda texts: (model.score(shape(texts, table)) >= threshold).tolist())
