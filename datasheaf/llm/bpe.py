"""Byte-level BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens and accepts just the sequences that BPE produces. It starts as one state with
a loop for every byte. Each merge (u, v) -> w, in order, is a gadget on it: the state behind u loses its
arc v, every state with an arc u gets an arc w, and w leads to a copy of the state behind v. The state
behind an arc depends on the arc's label only, so there is one state for each token, and an arc is looked
up by walking the copies back in time: `Automaton.arc`. Encoding runs a word through the trie of labels
and the automaton at once: every prefix of a word is reached by exactly one accepted token sequence, so
each position keeps one state and the word's ids are read off backwards. Decoding emits arc labels.

A text is cut where a single space stands between two other characters. Such a cut is a word boundary of
the tokenizer whatever surrounds it, and the pieces between repeat a lot: each task keeps a bounded
memory of pieces and their ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasheaf.llm.common import sliced, whole_row

MEMORY_PIECES = 400_000
LONGEST_REMEMBERED = 64
# The tokenizer's word pattern, and the white space it means by \s.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{l}{n}]+|[{S}]+(?![^{S}])|[{S}]+")
WORDS = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}", S=SPACE))
# The same for texts below U+0250, where the classes are short enough for the faster library.
LATIN_L, LATIN_N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = re.compile(PATTERN.format(L=f"[{LATIN_L}]", N=f"[{LATIN_N}]", l=LATIN_L, n=LATIN_N, S="\t-\r \x85\xa0"))
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
CUT = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
RARE_SPACE = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words(text: str) -> list[str]:
    """Pre-split words of a text without added tokens."""
    return (WORDS if BEYOND_LATIN.search(text) else LATIN).findall(text)


def pieces(text: str) -> list[str]:
    """The text cut before single spaces between other characters; every piece is whole words."""
    if not text:
        return []
    odd = "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or RARE_SPACE.search(text)
    parts = CUT.split(text) if odd else text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


def byte_names() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for b, c in [*zip(plain, plain, strict=True), *((b, 256 + i) for i, b in enumerate(rest))]}


def read_vocabulary(path: str) -> dict:
    """Byte ids, merges and added tokens of a byte-level BPE file; plain values, of the file's size."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        raise ValueError(f"{path} is not a byte-level BPE file of the kind that is supported")
    vocab, names = model["vocab"], byte_names()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {
        "bytes": {names[c]: vocab[c] for c in names if c in vocab},
        "merges": np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int32),
        "added": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


class Automaton:
    """The token automaton with the trie of its labels."""

    def __init__(self, vocabulary: dict):
        self.label: dict[int, bytes] = {i: bytes([b]) for b, i in vocabulary["bytes"].items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = dict.fromkeys(self.label, -1)
        self.lost: dict[tuple[int, int], int] = {}
        for time, (u, v, w) in enumerate(vocabulary["merges"].tolist()):
            self.gadget(time, u, v, w)
        # The trie of labels: for each node, the next node and its token (-1: none) by byte.
        self.trie: list[dict[int, tuple[int, int]]] = [{}]
        for w, text in sorted(self.label.items(), key=lambda x: len(x[1])):
            node = 0
            for b in text[:-1]:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie), -1
                    self.trie.append({})
                node = self.trie[node][b][0]
            self.trie[node][text[-1]] = self.trie[node].get(text[-1], (len(self.trie), -1))[0], w
            if self.trie[node][text[-1]][0] == len(self.trie):
                self.trie.append({})
        self.added: dict[str, int] = vocabulary["added"]
        for text, i in self.added.items():
            self.label[i] = text.encode()
        longest = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.emits = [self.label.get(i, b"") for i in range(max(self.label, default=-1) + 1)]
        self.arcs: dict[int, dict[int, bool]] = {}
        self.known_arcs = 0

    def gadget(self, time: int, u: int, v: int, w: int) -> None:
        """Merge u and v: the state behind u loses arc v, arcs u are joined by arcs w to a copy of v's state."""
        if w in self.born:
            return
        self.lost[u, v] = time
        self.left[w], self.right[w], self.born[w] = u, v, time
        self.label[w] = self.label[u] + self.label[v]

    def arc(self, state: int, token: int) -> bool:
        """Whether the state behind a token has an arc for another token."""
        row = self.arcs.setdefault(state, {})
        known = row.get(token)
        if known is None:
            known = row[token] = self.arc_in_time(state, token)
            self.known_arcs += 1
        return known

    def trim(self) -> None:
        """Forget looked-up arcs when there are many."""
        if self.known_arcs > 8 * MEMORY_PIECES:
            self.arcs.clear()
            self.known_arcs = 0

    def arc_in_time(self, state: int, token: int) -> bool:
        born, now = self.born, float("inf")
        while True:
            if self.lost.get((state, token), now) < now:
                return False
            if born[token] < 0 and born[state] < 0:
                return True
            if born[token] >= born[state]:
                # The arc was made beside the arc of the token's left part, just after a loss at that time.
                now = min(now, born[token] + 0.5)
                token = self.left[token]
            else:
                # The state was copied from that of its right part, before any loss at that time.
                now = min(now, float(born[state]))
                state = self.right[state]

    def encode(self, word: bytes) -> list[int]:
        """Ids of a pre-split word."""
        self.trim()
        n, trie, root = len(word), self.trie, self.trie[0]
        came: list[int] = [-1] * (n + 1)
        last: list[int] = [-1] * (n + 1)
        came[0] = 0
        for j in range(n):
            if came[j] < 0:
                continue
            before, node = last[j], root
            row = self.arcs.get(before)
            if row is None:
                row = self.arcs[before] = {}
            for k in range(j, n):
                hit = node.get(word[k])
                if hit is None:
                    break
                at, t = hit
                node = trie[at]
                if t >= 0:
                    ok = row.get(t)
                    if ok is None:
                        ok = row[t] = before < 0 or self.arc_in_time(before, t)
                        self.known_arcs += 1
                    if ok:
                        came[k + 1], last[k + 1] = j, t
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = came[at]
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs in turn, as text; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.emits.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """An automaton with a bounded memory of the ids of `most` pieces and as many words, as little-endian bytes."""

    def __init__(self, automaton: Automaton, most: int = MEMORY_PIECES):
        self.automaton, self.memory, self.word_memory, self.most = automaton, {}, {}, most

    def word(self, w: str) -> bytes:
        got = self.word_memory.get(w)
        if got is None:
            got = np.array(self.automaton.encode(w.encode("utf-8", "surrogatepass")), "<u4").tobytes()
            if len(w) <= LONGEST_REMEMBERED:
                if len(self.word_memory) >= self.most:
                    self.word_memory.clear()
                self.word_memory[w] = got
        return got

    def piece(self, p: str) -> bytes:
        got = self.memory.get(p)
        if got is None:
            got = b"".join([self.word(w) for w in words(p)])
            if len(p) <= LONGEST_REMEMBERED:
                if len(self.memory) >= self.most:
                    self.memory.clear()
                self.memory[p] = got
        return got

    def text(self, text: str) -> bytes:
        """Ids of a whole text; added tokens inside it get their own ids."""
        a = self.automaton
        if a.added_pattern is None or not any(t in text for t in a.added):
            memory = self.memory
            return b"".join([memory.get(p) or self.piece(p) for p in pieces(text)])
        out = []
        for part in a.added_pattern.split(text):
            if part in a.added:
                out.append(np.array([a.added[part]], "<u4").tobytes())
            else:
                out.extend(map(self.piece, pieces(part)))
        return b"".join(out)


def shared(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary for all tasks (its size is the file's) with a place for what a worker builds of it."""
    return spark.sparkContext.broadcast({"vocabulary": read_vocabulary(path), "built": {}})


def of_worker(held: Broadcast, name: str, build: Callable[[dict], object]) -> object:
    """What this worker process has built from the vocabulary; built once, whatever its number of tasks."""
    built = held.value["built"]
    if name not in built:
        built[name] = build(held.value["vocabulary"])
    return built[name]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the token ids of `text` in an array column `ids`, which replaces a column of that name."""
    held = shared(docs.sparkSession, path)
    framed = docs.select(whole_row(docs, [c for c in docs.columns if c != ids]), F.col(f"`{text}`").alias("text"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = of_worker(held, "encoder", lambda v: Encoder(Automaton(v)))
        for b in sliced(batches):
            out = [np.frombuffer(e.text(t or ""), "<i4") for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["row"], id_lists(out)], ["row", "out"])
    return with_column(framed, run, T.ArrayType(T.IntegerType()), ids)


def id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))


def encode_exactly(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", exact: str = "exact") -> DataFrame:
    """`docs` with the token ids of `text` and whether decoding them gives it again; a null text is empty.

    Both in one pass over few rows at a time: a worker builds one automaton, holds the ids of one slice and
    remembers fewer pieces than elsewhere, as it may stand beside the workers of earlier stages.
    The two columns replace columns of their names; rows are kept as they are, repeated ones as well.
    """
    held = shared(docs.sparkSession, path)
    framed = docs.select(whole_row(docs, [c for c in docs.columns if c not in (ids, exact)]), F.col(f"`{text}`").alias("text"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = of_worker(held, "encoder", lambda v: Encoder(Automaton(v), MEMORY_PIECES // 16))
        for b in sliced(batches, 128):
            out, same = [], []
            for t in b["text"]:
                given = t.as_py() or ""
                out.append(np.frombuffer(e.text(given), "<i4"))
                same.append(e.automaton.decode(out[-1].tolist()) == given)
            yield pa.RecordBatch.from_arrays([b["row"], id_lists(out), pa.array(same, pa.bool_())], ["row", "ids", "exact"])
    kinds = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())]
    rows = framed.mapInArrow(run, T.StructType([framed.schema["row"], *kinds]))
    return rows.select("row.*", F.col("ids").alias(ids), F.col("exact").alias(exact))


def with_column(framed: DataFrame, run: Callable, kind: T.DataType, name: str) -> DataFrame:
    """The rows of `framed` (row, ...) unpacked, with the column that `run` adds to them."""
    schema = T.StructType([framed.schema["row"], T.StructField("out", kind)])
    return framed.mapInArrow(run, schema).select("row.*", F.col("out").alias(name))


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`tokens` with the text of the array column `ids` in a column `text`; null ids give null."""
    held = shared(tokens.sparkSession, path)
    framed = tokens.select(whole_row(tokens, [c for c in tokens.columns if c != text]), F.col(f"`{ids}`").alias("ids"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = of_worker(held, "automaton", Automaton)
        for b in sliced(batches):
            out = pa.array([None if x is None else a.decode(x) for x in b["ids"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b["row"], out], ["row", "out"])
    return with_column(framed, run, T.StringType(), text)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, then decoded from the ids.

    A null text is empty; an empty text has no tokens. Repeated rows are encoded alike; other columns are
    left out.
    """
    held = shared(docs.sparkSession, path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = of_worker(held, "encoder", lambda v: Encoder(Automaton(v)))
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in b["text"]:
                ids = e.text(t.as_py())
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded = e.automaton.decode(np.frombuffer(ids, "<u4").tolist())
                text_sha.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
