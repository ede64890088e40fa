"""Quality rules by distribution divergence.

A text is compared with references of languages: the share of each character class among its characters
outside white space, and the share of each of a language's commonest words among its words (all other
words together). The Jensen-Shannon distance (square root of the divergence to base 2, from 0 to 1) says
how far it is. A text passes when at least one reference is near enough in both respects; a distance counts
only from a least length on, because the histograms of short texts are mostly noise.

References are counted over all documents. A text is compared with all references and not with that of its
own `lang` alone, so a wrong or missing language takes nothing away.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datasheaf.llm.common import sliced, written

CLASSES = ("lower", "upper", "other letter", "mark", "digit", "sentence", "symbol", "other punctuation", "other")
SENTENCE = ".,;:!?'\"-()…’“”«»¿¡、。，"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
PUNCTUATION = b".,;:!?'\"-()[]{}#*$%&|<>/\\_=+~^`@"
# Commonest words of a reference, and languages that get one.
COMMON_WORDS = 100
LANGUAGES = 64
# A distance above its limit fails a text of at least so many characters or words.
CLASS_LIMIT, CLASS_LEAST = 0.32, 200
WORD_LIMIT, WORD_LEAST = 0.55, 50
MIN_WORDS = 50
REPEATED_PERCENT = 50


@functools.lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point, by its Unicode category; white space of the word rule has none (255)."""
    kinds = {"Ll": 0, "Lu": 1, "Lt": 1, "Lo": 2, "Lm": 2, "Mn": 3, "Mc": 3, "Me": 3, "Nd": 4, "Nl": 4, "No": 4,
             "Sm": 6, "Sc": 6, "Sk": 6, "So": 6, "Pc": 7, "Pd": 7, "Ps": 7, "Pe": 7, "Pi": 7, "Pf": 7, "Po": 7}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i)), 8) for i in range(0x110000)), np.uint8, 0x110000)
    for members, kind in ((SENTENCE, 5), (SYMBOLS, 6), (SPACES, 255)):
        table[[ord(c) for c in members]] = kind
    return table


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(class_table()[codes], minlength=256)[:len(CLASSES)]


def words_of(text: str) -> list[bytes]:
    """Words as the rule `[^\\x20\\x09-\\x0D]+` finds them: bytes are split at just that white space."""
    return text.encode("utf-8", "surrogatepass").split()


def plain_words(text: str) -> list[bytes]:
    """Words in lower case without punctuation around them."""
    return [w.strip(PUNCTUATION) for w in words_of(text.lower())]


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of `size` words that the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    windows, distinct = ids[:n], len(number)
    for i in range(1, size):
        # Renumbered after each step, so that the numbers stay below rows * words.
        windows = np.unique(windows * distinct + ids[i:n + i], return_inverse=True)[1]
    found = np.bincount(windows)[windows] > 1
    inside = np.zeros(len(words), bool)
    for i in range(size):
        inside[i:n + i] |= found
    return int(inside.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = words_of(text)
    return (len(words), len(text) - sum(text.count(c) for c in SPACES), sum(text.count(c) for c in SYMBOLS),
            repeated_lines(text), repeated_words(words))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the last axis of two arrays of shares."""
    m = (p + q) / 2
    def against(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=-1)
    return np.sqrt(np.maximum(0.0, (against(p) + against(q)) / 2))


def shares(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=-1, keepdims=True)
    return counts / np.maximum(total, 1)


@dataclass
class References:
    """Shares of the character classes and of the commonest words (last: all others) of each language."""

    languages: list[str]
    classes: np.ndarray
    words: list[list[bytes]]
    word_shares: np.ndarray

    def distances(self, text: str) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Distance to each reference by classes and by words, and the characters and words compared."""
        counts = class_counts(text)
        words = Counter(plain_words(text))
        total = sum(words.values())
        hist = np.zeros(self.word_shares.shape)
        for i, common in enumerate(self.words):
            hist[i, :len(common)] = [words.get(w, 0) for w in common]
            hist[i, -1] = total - hist[i].sum()
        return (distance(shares(counts.astype(float)), self.classes), distance(shares(hist), self.word_shares),
                int(counts.sum()), total)

    def accepts(self, text: str) -> bool:
        """True when some reference is near enough, or there is none."""
        if not self.languages:
            return True
        by_class, by_word, chars, words = self.distances(text)
        near = (by_class <= CLASS_LIMIT) | (chars < CLASS_LEAST)
        return bool((near & ((by_word <= WORD_LIMIT) | (words < WORD_LEAST))).any())


COUNTED = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("item", pa.string()), ("n", pa.int64())])
# Entries that a task adds up before it passes them on.
HELD_ENTRIES = 100_000


def counted(docs: DataFrame) -> DataFrame:
    """lang, kind (`c` classes, `w` words), item, n over all documents that name a language.

    Each task adds up what it can hold and passes it on; the shuffle adds the rest.
    """
    def batch(held: Counter) -> pa.RecordBatch:
        columns = zip(*[(*key, n) for key, n in held.items()], strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, COUNTED.types, strict=True)], schema=COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in sliced(batches):
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                for i, n in enumerate(class_counts(text)):
                    held[lang, "c", str(i)] += int(n)
                for w, n in Counter(plain_words(text)).items():
                    held[lang, "w", w.decode()] += n
                if len(held) > HELD_ENTRIES:
                    yield batch(held)
                    held = Counter()
        if held:
            yield batch(held)

    named = docs.filter("lang IS NOT NULL").select("lang", F.coalesce("text", F.lit("")).alias("text"))
    parts = named.mapInArrow(run, "lang string, kind string, item string, n long")
    return parts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, languages: int = LANGUAGES, common: int = COMMON_WORDS) -> References:
    """References of the `languages` with the most characters, counted over all documents.

    Only these shares reach the driver: a row for each class and each common word of a reference. Rows
    without a language give none; without any there are no references, and every text passes.
    """
    all_counts = written(counted(docs), "histograms")
    chars = all_counts.filter("kind = 'c'")
    largest = chars.groupBy("lang").agg(F.sum("n").alias("total")).filter("total > 0").orderBy(F.desc("total"), "lang").limit(languages)
    names = [r["lang"] for r in largest.collect()]
    ours = F.col("lang").isin(names)
    classes = np.zeros((len(names), len(CLASSES)))
    for r in chars.filter(ours).collect():
        classes[names.index(r["lang"]), int(r["item"])] = r["n"]
    words = all_counts.filter("kind = 'w'").filter(ours)
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "item")
    most = words.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= common).orderBy("lang", "rank")
    listed: list[list[tuple[bytes, int]]] = [[] for _ in names]
    for r in most.collect():
        listed[names.index(r["lang"])].append((r["item"].encode(), r["n"]))
    hist = np.zeros((len(names), common + 1))
    for i, found in enumerate(listed):
        hist[i, :len(found)] = [n for _, n in found]
        hist[i, -1] = totals.get(names[i], 0) - hist[i].sum()
    return References(names, shares(classes), [[w for w, _ in found] for found in listed], shares(hist))


SCORED = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def base_fails(n_words: int, n_repeat_words: int, least: int = MIN_WORDS, percent: int = REPEATED_PERCENT) -> bool:
    return n_words < least or 100 * n_repeat_words > percent * n_words


def judge(docs: DataFrame, references: References) -> DataFrame:
    """Counts of every whole text, whether the base rules fail it, and whether it is kept.

    A null text is empty: no words, so the base rules fail it. Repeated rows and rows without an id are
    judged each by itself; other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(references)

    def row(doc_id: int | None, text: str) -> tuple:
        n_words, chars, symbols, lines, repeated = base_counts(text)
        failed = base_fails(n_words, repeated)
        return doc_id, n_words, chars, symbols, lines, repeated, failed, not failed and sent.value.accepts(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [row(i, t) for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCORED.types, strict=True)], schema=SCORED)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                "n_repeat_words long, base_failed boolean, kept boolean")
