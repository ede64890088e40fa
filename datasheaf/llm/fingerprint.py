"""Document fingerprints by a homomorphic multiset hash over paragraphs.

A fingerprint is a wide vector of sums modulo 2^64. Every paragraph adds its own vector, so the order
of paragraphs has no influence, and a paragraph is inserted or deleted by adding or subtracting its
vector. A paragraph's vector is the signed hash of the whole paragraph plus the signed hashes of its
sentences, these weighed by the root of their length: the inner product of two fingerprints then
estimates how many characters the texts share, and likeness divides it by the larger text's own. A long
sentence is cut where a hash of three characters says so, the same wherever the passage stands, so a text
without full stops is not one single part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datasheaf.llm.common import spread_count

LANES = 256
MARKS = ".!?。！？｡؟।…"
SENTENCE = re.compile(f"[^{MARKS}]*[{MARKS}]+|[^{MARKS}]+")
HASHED_AT_ONCE = 4096
# Sentences above this length are cut, into pieces of 2^CUT_BITS characters on average.
LONG_SENTENCE, CUT_BITS = 160, 6
MIXERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def pieces_of(sentence: str) -> list[str]:
    """The sentence, or its pieces where it is long; the ends of pieces depend on the three characters before them only."""
    if len(sentence) <= LONG_SENTENCE:
        return [sentence]
    c = np.frombuffer(sentence.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = c[:-2] * np.uint64(MIXERS[0]) + c[1:-1] * np.uint64(MIXERS[1]) + c[2:] * np.uint64(MIXERS[2])
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - CUT_BITS)
    ends = [0, *(np.flatnonzero(h == 0) + 3).tolist(), len(sentence)]
    return [sentence[a:b] for a, b in zip(ends, ends[1:], strict=False) if a < b]


def parts(text: str) -> list[tuple[bytes, int]]:
    """The hashed parts of a text with their weights, paragraph by paragraph."""
    out = []
    for paragraph in text.split("\n"):
        out.append((b"P" + paragraph.encode("utf-8", "surrogatepass"), 1))
        for sentence in SENTENCE.findall(paragraph):
            for s in pieces_of(sentence):
                out.append((b"S" + s.encode("utf-8", "surrogatepass"), isqrt(len(s))))
    return out


def vector(pieces: Iterable[tuple[bytes, int]]) -> np.ndarray:
    """Sum of the parts' signed hashes modulo 2^64, as unsigned lanes."""
    pieces = list(pieces)
    total = np.zeros(LANES, np.uint64)
    for at in range(0, len(pieces), HASHED_AT_ONCE):
        some = pieces[at:at + HASHED_AT_ONCE]
        digests = b"".join([hashlib.blake2b(p, digest_size=LANES // 8).digest() for p, _ in some])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(len(some), LANES)
        weights = np.array([w for _, w in some], np.uint16)
        # +w for a clear bit and -w for a set one; sums of float32 are exact below 2^24.
        set_sum = (weights.astype(np.float32) @ bits.astype(np.float32)) if weights.max(initial=0) < 4096 else (
            (weights[:, None].astype(np.int64) * bits).sum(0))
        total += (int(weights.sum(dtype=np.int64)) - 2 * set_sum.astype(np.int64)).astype(np.uint64)
    return total


def insert(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    return fingerprint + vector(parts(paragraph))


def delete(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    return fingerprint - vector(parts(paragraph))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the larger text that both have: 1 for equal fingerprints, about 0 for strangers."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a.astype(np.int64).astype(float), b.astype(np.int64).astype(float)
    most = max(x @ x, y @ y)
    return float(min(1.0, max(0.0, (x @ y) / most))) if most else 0.0


def printed(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype("<u8").tobytes()).decode()


def parsed(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text, or all of it."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
ROWS_OUT = 1024


class Hashed:
    """A text with its parts and fingerprint."""

    def __init__(self, text: str):
        self.text, self.parts = text, parts(text)
        self.sum = vector(self.parts)


def compared(doc_id: int | None, a: Hashed, following: Hashed) -> tuple:
    """Output row of one document. Only parts that the edit touched are hashed again."""
    changed = edited(a.text, following.text)
    new = parts(changed)
    same = next((i for i, (x, y) in enumerate(zip(a.parts, new, strict=False)) if x != y), min(len(a.parts), len(new)))
    e = a.sum - vector(a.parts[same:]) + vector(new[same:])
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(a.text), sha, printed(a.sum), printed(e), likeness(a.sum, e), likeness(a.sum, following.sum)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = ROWS_OUT) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row of a sorted partition but the last, compared with the row after it."""
    def rows() -> Iterator[tuple]:
        before = None
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                now = doc_id, Hashed(text.as_py())
                if before:
                    yield compared(*before, now[1])
                before = now
    return in_batches(rows(), ARROW)


ENDS = pa.schema([("part", pa.int32()), ("first_text", pa.string()), ("doc_id", pa.int64()), ("text", pa.string())])


def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First text and last document of a partition."""
    first = last = None
    for b in batches:
        if b.num_rows:
            first = b["text"][0].as_py() if first is None else first
            last = b["doc_id"][-1].as_py(), b["text"][-1].as_py()
    if last:
        yield from in_batches([(TaskContext.get().partitionId(), first, *last)], ENDS)


def closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last document of each partition, compared with the first text of the next."""
    def rows() -> Iterator[tuple]:
        for b in batches:
            for doc_id, text, following in zip(*[b[c].to_pylist() for c in ("doc_id", "text", "following")], strict=True):
                yield compared(doc_id, Hashed(text), Hashed(following))
    return in_batches(rows(), ARROW)


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its text edited with the next one's, in descending doc_id.

    A null text is empty; an empty text has a fingerprint, equal to other empty texts'. Rows without an
    id come last; rows with one id follow each other by the hash of their text. After the last row comes
    the first; a single row follows itself. Other columns are left out. The texts are shuffled once, by
    ranges of ids: both readers share that exchange, and only the ends of the ranges meet again.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    keys = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    dealt = rows.repartitionByRange(spread_count(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    inner = dealt.mapInArrow(neighbours, SCHEMA)
    edges = dealt.mapInArrow(ends, "part int, first_text string, doc_id long, text string")
    by = Window.orderBy("part")
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("first_text").over(by), F.first("first_text").over(everything))
    return inner.unionByName(edges.select("doc_id", "text", following.alias("following")).mapInArrow(closing, SCHEMA))
