"""Token counts by a compiled finite-state transducer.

The transducer reads the bytes of a word and says after each byte by how much the number of tokens of
the prefix read so far has changed. Its state holds the token that ends here and the unfinished labels
that began at earlier positions, each with the token before it and its count relative to here; states
are made deterministic as they are met and kept in a table, bounded by forgetting. A long text is cut into
chunks anywhere. What a chunk does to an unknown state before it is kept as a map: the head that the
state before must finish, the count of the whole pieces between, and the tail that is still open. Maps
compose associatively, so the chunks of a text are combined by a parallel prefix scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasheaf.llm.bpe import LONGEST_REMEMBERED, MEMORY_PIECES, Automaton, of_worker, pieces, shared, words

CHUNK_CHARS = 1 << 16
MOST_STATES = 200_000


class Transducer:
    """Deterministic byte transducer; transitions carry the change in the number of tokens."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.forget()

    def forget(self) -> None:
        # A state: its unfinished labels as (trie node, token before, count relative to here).
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.table: dict[int, tuple[int, int]] = {}

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """Transition of a state that was not met with this byte yet."""
        a = self.automaton
        a.trim()
        open_labels, ended = [], None
        for node, before, count in self.states[state]:
            hit = a.trie[node].get(byte)
            if hit is None:
                continue
            node, token = hit
            if a.trie[node]:
                open_labels.append((node, before, count))
            if token >= 0 and (before < 0 or a.arc(before, token)):
                ended = token, count + 1
        token, change = ended
        new = (*((n, t, c - change) for n, t, c in open_labels), (0, token, 0))
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
        self.table[state << 8 | byte] = to, change
        return to, change

    def count(self, word: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.forget()
        state = total = 0
        for b in word:
            to = self.table.get(state << 8 | b)
            if to is None:
                to = self.compile(state, b)
                if len(self.states) > 4 * MOST_STATES:
                    # One word with that many states: go on from this one in an emptied table.
                    here = self.states[to[0]]
                    self.forget()
                    self.number[here] = 1
                    self.states.append(here)
                    to = 1, to[1]
            state, change = to
            total += change
        return total


class Counter:
    """Counts of pieces, from memory where they were met before."""

    def __init__(self, automaton: Automaton):
        self.transducer, self.memory = Transducer(automaton), {}
        self.added, self.pattern = automaton.added, automaton.added_pattern

    def piece(self, p: str) -> int:
        n = self.memory.get(p)
        if n is None:
            n = sum(self.transducer.count(w.encode("utf-8", "surrogatepass")) for w in words(p))
            if len(p) <= LONGEST_REMEMBERED:
                if len(self.memory) >= MEMORY_PIECES:
                    self.memory.clear()
                self.memory[p] = n
        return n

    def chunk(self, text: str) -> ChunkMap:
        parts = pieces(text)
        if len(parts) < 4:
            return ChunkMap(text, None, 0)
        # The outer two pieces on either side wait for what the neighbours hold.
        return ChunkMap("".join(parts[:2]), "".join(parts[-1:]), sum(map(self.piece, parts[2:-1])))

    def join(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b."""
        if a.tail is None and b.tail is None:
            return ChunkMap(a.head + b.head, None, 0)
        if a.tail is None:
            return ChunkMap(a.head + b.head, b.tail, b.count)
        if b.tail is None:
            return ChunkMap(a.head, a.tail + b.head, a.count)
        return ChunkMap(a.head, b.tail, a.count + sum(map(self.piece, pieces(a.tail + b.head))) + b.count)

    def finish(self, m: ChunkMap) -> int:
        return sum(map(self.piece, pieces(m.head))) + m.count + (sum(map(self.piece, pieces(m.tail))) if m.tail else 0)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix scan in rounds of doubling distance; the joins of a round do not depend on each other."""
        far = 1
        while far < len(maps):
            maps = [m if i < far else self.join(maps[i - far], m) for i, m in enumerate(maps)]
            far *= 2
        return maps

    def segment(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        if len(text) <= chunk:
            memory = self.memory
            return sum([memory.get(p) or self.piece(p) for p in pieces(text)])
        return self.finish(self.scan([self.chunk(text[i:i + chunk]) for i in range(0, len(text), chunk)])[-1])

    def text(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        if self.pattern is None or not any(t in text for t in self.added):
            return self.segment(text, chunk)
        return sum(1 if s in self.added else self.segment(s, chunk) for s in self.pattern.split(text))


class ChunkMap:
    """What a chunk does to the state before it. Without a certain cut inside (`tail` None) it is all head."""

    def __init__(self, head: str, tail: str | None, count: int):
        self.head, self.tail, self.count = head, tail, count


def counted(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row.

    A null text is empty and has neither bytes nor tokens; other columns are left out.
    """
    held = shared(docs.sparkSession, path)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = of_worker(held, "counter", lambda v: Counter(Automaton(v)))
        for b in batches:
            n = [counter.text(t.as_py(), chunk) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
