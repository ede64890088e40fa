"""Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Shingles are 64-bit hashes. Texts with equal sets are one node. Candidates share prefix tokens under two
different orders of the tokens, and then the full sets are compared.

* A node's window under an order is its first WINDOW tokens. Under a random order each of the first tokens
  of two sets' union is outside their intersection with probability 0.2 at most, so linked sets share
  LEAST_SHARED tokens of both windows but for a rare accident (below 1e-14; with the ENOUGH deciding tokens
  below about 1e-11 a pair). Sets that fit into the window are compared by their exact bound.
* First the nodes that share one of the leading tokens are compared with one node of that group, a star
  of linear size. Links among them give components, and all that is at least roughly alike gives families.
* A family of several components is compared as a whole, in pairs of blocks of BLOCK nodes each: a task
  counts the shared shingles of two blocks by an index of their tokens and returns only links that join
  two components. So texts that are alike by a little less than the threshold never become rows of pairs.
* Then all pairs from different families that share a window token under the first order are
  candidates. Tokens that more than COMMON families hold are left out; a node that still has enough
  other tokens cannot miss a partner by that (`light`).
* The other nodes, mostly made of common tokens, meet under a third order: rarest first, by counts of buckets
  of tokens among such nodes, with the exact prefix of floor(n / 5) + 1 tokens and no token left out.
* Candidates of either kind must share tokens in both windows before their sets are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasheaf.llm.common import sliced, whole_row, written
from datasheaf.llm.components import components
from datasheaf.operators.positions import group_index

SHINGLE, WINDOW, LEADING, COMMON, LEAST_SHARED, ENOUGH = 5, 40, 4, 12, 10, 28
# Nodes of a block, and the shared part of the windows (in percent) that makes a family.
BLOCK, ALIKE = 256, 65
CHUNK_BYTES = 1 << 20
# Ids with their nodes are sent to every task up to this many (some 50 MB); beyond that the texts are joined by a shuffle.
SENT_IDS = 500_000
# At most 2 to this power buckets of tokens are counted (4 MB), packed into so many rows of a task.
BUCKET_BITS, SLOTS = 20, 16
WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
ODD = np.random.default_rng(5).integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LETTER, PLACE, SHORT = ODD[:256], ODD[256:256 + SHINGLE], ODD[280:280 + SHINGLE]
BASE = int(ODD[299])


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers well stirred."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, modulo 2^64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            run = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64)
            self.up, self.down = run(np.uint64(BASE)), run(np.uint64(pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


def shingle_sets(texts: list[str], powers: Powers) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; an empty array without words.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space. With one to four words the
    whole sequence is the only shingle.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        to, size = at, 0
        while to < len(raw) and (to == at or size + len(raw[to]) < CHUNK_BYTES):
            size += len(raw[to]) + 1
            to += 1
        out.extend(sets_of_chunk(raw[at:to], powers))
        at = to
    return out


def sets_of_chunk(raw: list[bytes], powers: Powers) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    up, down = powers.to(len(data) + 1)
    inside = ~WHITE[data]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.r_[np.uint64(0), np.cumsum(LETTER[data] * up[:-1], dtype=np.uint64)]
    word = mixed((sums[ends] - sums[starts]) * down[starts])
    bounds = np.searchsorted(starts, np.r_[0, np.cumsum([len(r) + 1 for r in raw])])
    n = max(len(word) - SHINGLE + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        rolled += word[k:k + n] * PLACE[k]
    rolled = mixed(rolled)
    result = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= SHINGLE:
            result.append(np.unique(rolled[lo:hi - SHINGLE + 1]))
        elif hi > lo:
            m = hi - lo
            result.append(mixed((word[lo:hi] * PLACE[:m]).sum(dtype=np.uint64, keepdims=True) + SHORT[m]))
        else:
            result.append(np.zeros(0, np.uint64))
    return result


def windows(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens under the order of the hashes and under that of the hashes stirred again."""
    if len(s) <= WINDOW:
        return s, s
    return s[:WINDOW], s[np.argpartition(mixed(s ^ ODD[290]), WINDOW)[:WINDOW]]


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def node_of(s: np.ndarray) -> bytes | None:
    return hashlib.md5(s.tobytes()).digest() if len(s) else None


def texts_only(docs: DataFrame) -> DataFrame:
    """doc_id, text and its hash, which tells rows of one id (or none) apart."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, n and both windows of every row."""
    names = ["doc_id", "text_hash", "node", "n", "w1", "w2"]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in sliced(batches):
            sets = shingle_sets(b["text"].to_pylist(), powers)
            w = [windows(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["text_hash"], pa.array([node_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 lists([x for x, _ in w]), lists([y for _, y in w])], names)
    return texts_only(docs).mapInArrow(run, "doc_id long, text_hash long, node binary, n long, w1 array<long>, w2 array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """nid and sorted shingles of the wanted nodes (nid, doc_id, text_hash, node), computed again from their texts."""
    wanted = written(wanted.select("nid", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("node").alias("expected")), "wanted")
    count = wanted.count()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in sliced(batches):
            sets = shingle_sets(b["text"].to_pylist(), powers)
            keep = pa.array([node_of(s) == e.as_py() for s, e in zip(sets, b["expected"], strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([b["nid"], pa.array([s.tobytes() for s in sets], pa.binary())], ["nid", "shingles"])
            yield out.filter(keep)
    texts = texts_only(docs)
    side = F.broadcast(wanted) if count <= SENT_IDS else wanted
    same = texts["doc_id"].eqNullSafe(side["id"]) & (texts["text_hash"] == side["hash"])
    rows = texts.join(side, same).select("nid", "text", "expected")
    sets = written(rows.mapInArrow(run, "nid long, shingles binary"), "sets")
    # More rows than nodes: some row is repeated with its id.
    return sets if sets.count() == count else written(sets.dropDuplicates(["nid"]), "sets")


def sizes_fit(a: Column, b: Column) -> Column:
    return (a * 5 >= b * 4) & (b * 5 >= a * 4)


def windows_fit(a1: Column, b1: Column, na: Column, nb: Column) -> Column:
    """Enough shared tokens in two windows: the exact bound where both hold whole sets."""
    shared, larger = F.size(F.array_intersect(a1, b1)), F.greatest(na, nb)
    return F.when(larger <= WINDOW, shared * 5 >= larger * 4).otherwise(shared >= F.least(F.lit(LEAST_SHARED), na, nb))


def fitting(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) that may be similar by their sizes and both windows, and whether the windows are much `alike`."""
    side = lambda x: nodes.select(F.col("nid").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "w1", "w2")])
    near = pairs.join(side("u"), "u").join(side("v"), "v").filter(sizes_fit(F.col("u_n"), F.col("v_n")))
    alike = F.lit(True)
    for w in ("w1", "w2"):
        near = near.filter(windows_fit(F.col(f"u_{w}"), F.col(f"v_{w}"), F.col("u_n"), F.col("v_n")))
        shared = F.size(F.array_intersect(f"u_{w}", f"v_{w}"))
        alike &= shared * 100 >= F.least(F.greatest("u_n", "v_n"), F.lit(WINDOW)) * ALIKE
    return written(near.select("u", "v", alike.alias("alike")), "fitting")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("nid")).unionByName(pairs.select(F.col("v").alias("nid"))).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar."""
    held = lambda x: sets.select(F.col("nid").alias(x), F.col("shingles").alias(f"{x}_set"))
    both = pairs.join(held("u"), "u").join(held("v"), "v")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            keep = []
            for x, y in zip(b["u_set"], b["v_set"], strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= 80 * (len(s) + len(t) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
    return both.select("u", "v", "u_set", "v_set").mapInArrow(run, "u long, v long")


def shared_counts(token_lists: list[np.ndarray], rows: range) -> Iterator[tuple[int, np.ndarray]]:
    """For each of `rows`: how many tokens it shares with every list, by an index of the lists that hold a token."""
    sizes = np.array([len(t) for t in token_lists])
    owner = np.repeat(np.arange(len(token_lists)), sizes)
    _, ids = np.unique(np.concatenate(token_lists), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    holders, ends = owner[order], np.cumsum(np.bincount(ids))
    starts = np.r_[0, ends[:-1]]
    first = np.r_[0, np.cumsum(sizes)]
    for i in rows:
        own = ids[first[i]:first[i + 1]]
        yield i, np.bincount(np.concatenate([holders[starts[t]:ends[t]] for t in own]), minlength=len(token_lists))


def links_of_blocks(comps: list[int], token_lists: list[np.ndarray], left: int) -> list[tuple[int, int]]:
    """Links between the first `left` nodes and all nodes that join components which no other link here has joined."""
    up: dict[int, int] = {c: c for c in comps}
    def find(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c
    sizes = np.array([len(t) for t in token_lists])
    out = []
    for i, both in shared_counts(token_lists, range(left)):
        for j in np.flatnonzero(100 * both >= 80 * (sizes + sizes[i] - both)):
            a, b = find(comps[i]), find(comps[j])
            if a != b:
                up[a] = b
                out.append((i, int(j)))
    return out


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each pair of blocks; rows come sorted by family, pair and block."""
    held: list[tuple] = []
    def links() -> pa.RecordBatch:
        here = [r[4:] for r in held]
        left = sum(r[3] == held[0][1] for r in held)
        found = links_of_blocks([c for _, c, _ in here], [t for _, _, t in here], left)
        ends = list(zip(*[(here[i][0], here[j][0]) for i, j in found], strict=True)) or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["u", "v"])
    for b in batches:
        columns = [b[c].to_pylist() for c in ("fam", "lo", "hi", "block", "nid", "comp")]
        for *row, s in zip(*columns, b["shingles"], strict=True):
            if held and held[0][:3] != tuple(row[:3]):
                yield links()
                held = []
            held.append((*row, np.frombuffer(s.as_py(), np.uint64)))
    if held:
        yield links()


def within_families(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between components of one family; members: nid, comp, fam. Few enough to join what is linked."""
    placed = written(group_index(members, "fam", ["comp", "nid"], out="at"), "members")
    placed = placed.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long"))
    blocks = placed.groupBy("fam", "block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    side = lambda x: blocks.select("fam", F.col("block").alias(x), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high"))
    # Blocks are sorted by component: two that lie in one component need not be compared.
    settled = (F.col("lo_low") == F.col("lo_high")) & (F.col("hi_low") == F.col("hi_high")) & (F.col("lo_low") == F.col("hi_low"))
    pairs = side("lo").join(side("hi"), "fam").filter((F.col("lo") <= F.col("hi")) & ~settled).select("fam", "lo", "hi")
    pairs = written(pairs, "block-pairs")
    ends = [pairs.withColumn("block", F.col("lo")), pairs.filter("lo < hi").withColumn("block", F.col("hi"))]
    rows = placed.join(ends[0].unionByName(ends[1]), ["fam", "block"])
    rows = rows.join(sets, "nid").select("fam", "lo", "hi", "block", "nid", "comp", "shingles")
    keys = ["fam", "lo", "hi"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "block", "nid").mapInArrow(compared, "u long, v long")


def stars(nodes: DataFrame) -> DataFrame:
    """Pairs of each node with one node of its size for each leading token that they share.

    The centre of a token's star is drawn anew for every token, so that one that is far from the others of
    its family does not stand in the middle of all stars.
    """
    lead = lambda w: F.transform(F.slice(w, 1, LEADING), lambda t: F.struct(F.lit(w).alias("w"), t.alias("t")))
    band = F.floor(F.log("n") / F.log(F.lit(1.2))).alias("band")
    rows = nodes.select("nid", band, F.explode(F.concat(lead("w1"), lead("w2"))).alias("key"))
    drawn = F.min(F.struct(F.xxhash64("nid", "key").alias("at"), F.col("nid").alias("v"))).alias("s")
    centre = rows.groupBy("key", "band").agg(drawn, F.count("*").alias("k")).filter("k > 1").select("key", "band", "s.v")
    return rows.join(centre, ["key", "band"]).select(F.col("nid").alias("u"), "v").filter("u <> v").distinct()


def across(posts: DataFrame) -> DataFrame:
    """Pairs of nodes from different families that have a token in common; posts: nid, n, fam, token, pos.

    `pos` is the token's place in the node's order, from 0. At the first token that two nodes share, no
    more can be shared than what either has from there on; a pair that could not be similar even so is not
    made. A similar pair always passes at its first shared token.
    """
    held = posts.groupBy("token").agg(F.min("fam").alias("x"), F.max("fam").alias("y")).filter("x <> y").select("token")
    few = posts.join(held, "token")
    side = lambda x: few.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("nid", "n", "fam", "pos")])
    most = F.least(F.col("u_n") - F.col("u_pos"), F.col("v_n") - F.col("v_pos"))
    possible = (most * 9 >= (F.col("u_n") + F.col("v_n")) * 4) & sizes_fit(F.col("u_n"), F.col("v_n"))
    apart = (F.col("u_fam") != F.col("v_fam")) & (F.col("u_nid") < F.col("v_nid"))
    pairs = side("u").join(side("v"), "token").filter(apart & possible)
    return pairs.select(F.col("u_nid").alias("u"), F.col("v_nid").alias("v")).distinct()


def token_counts(sets: DataFrame, total: int) -> np.ndarray:
    """How many of `total` tokens fall into each bucket of the hash: as many buckets as tokens, up to a bound.

    Every task counts all its tokens and returns SLOTS packed parts of the counts; the parts are summed by slot.
    """
    bits = min(max(int(total).bit_length(), 10), BUCKET_BITS)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for b in sliced(batches):
            tokens = np.concatenate([np.frombuffer(s.as_buffer(), np.uint64) for s in b["shingles"]])
            np.add.at(counts, buckets(tokens, bits), np.uint32(1))
        parts = [x.tobytes() for x in np.split(counts, SLOTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS), pa.int32()), pa.array(parts, pa.binary())], ["slot", "counts"])
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, part in zip(b["slot"].to_pylist(), b["counts"], strict=True):
                sums[slot] = sums.get(slot, np.uint32(0)) + np.frombuffer(part.as_buffer(), np.uint32)
        parts = [x.tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(parts, pa.binary())], ["slot", "counts"])
    kind = "slot int, counts binary"
    parts = sets.select("shingles").mapInArrow(run, kind).repartition("slot").mapInArrow(added, kind)
    return np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in sorted(parts.collect())])


def buckets(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def rarest_first(heavy: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs among heavy nodes (nid, n, fam) that share a token of their exact prefixes, tokens of rare buckets first.

    Any order that all nodes share makes the prefixes exact; one by counts makes few pairs. Counts of buckets do for that
    and are small enough for every task, so only the tokens of prefixes become rows. A token alone in its bucket is held
    by one node: it takes a place in the prefix but makes no row.
    """
    every = written(heavy.join(sets, "nid").select("nid", "n", "fam", "shingles"), "heavy-sets")
    counts = token_counts(every, heavy.agg(F.sum("n")).first()[0])
    bits = len(counts).bit_length() - 1
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for nid, n, fam, s in zip(*[b[c].to_pylist() for c in ("nid", "n", "fam")], b["shingles"], strict=True):
                t = np.frombuffer(s.as_buffer(), np.uint64)
                often = counts[buckets(t, bits)]
                first = np.lexsort((t, often))[:n // 5 + 1]
                at = np.flatnonzero(often[first] > 1)
                same = [np.full(len(at), x, np.int64) for x in (nid, n, fam)]
                for column, x in zip(out, [*same, at, t[first[at]].view(np.int64)], strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["nid", "n", "fam", "pos", "token"])
    return across(written(every.mapInArrow(prefixes, "nid long, n long, fam long, pos long, token long"), "heavy-prefixes"))


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketches of every row, and (node, comp) of every node, comp being a number of its component."""
    rows = written(sketches(docs), "sketches")
    # Nodes get short numbers; they are written down, so a task that runs again cannot change them.
    some = rows.filter("n > 0").dropDuplicates(["node"]).withColumn("nid", F.monotonically_increasing_id())
    nodes = written(some, "nodes")
    # Tokens of one node only lead nowhere.
    tokens = nodes.select("nid", "n", F.explode("w1").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token")
    posts = written(tokens.join(shared, "token"), "posts")
    name = lambda ids: ids.join(nodes.select("nid", "doc_id", "text_hash", "node"), "nid")

    pairs = fitting(stars(nodes), nodes)
    sets = full_sets(docs, name(ends_of(pairs)))
    links = written(verified(pairs.select("u", "v"), sets), "links")
    first = components(links).select(F.col("u").alias("nid"), F.col("v").alias("comp"))
    alike = pairs.filter("alike").select("u", "v").unionByName(links)
    families = components(alike).select(F.col("u").alias("nid"), F.col("v").alias("fam"))
    # Everything in a family is an end of a pair, so its set is there.
    heads = families.select(F.col("fam").alias("nid")).distinct().withColumn("fam", F.col("nid"))
    members = families.unionByName(heads).join(first, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    members = written(members, "families")
    several = members.groupBy("fam").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("fam")
    inner = within_families(members.join(several, "fam", "left_semi"), sets)
    fam = F.coalesce("fam", "nid").alias("fam")
    posts = written(posts.join(families, "nid", "left").select("nid", "n", fam, "token"), "posts")

    common = posts.select("token", "fam").distinct().groupBy("token").agg(F.count("*").alias("k")).filter(F.col("k") > COMMON)
    common = written(common.select("token"), "common-tokens")
    # In the order that puts common tokens last, the first ones of a window decide for light nodes;
    # nodes with too few that are not common meet again among themselves.
    lost = posts.join(common, "token").groupBy("nid").agg(F.collect_set("token").alias("lost"))
    rest = nodes.join(families, "nid", "left").join(lost, "nid", "left").withColumn("fam", fam)
    rest = rest.withColumn("rest", F.array_except("w1", F.coalesce("lost", F.array().cast("array<long>"))))
    enough = F.least(F.floor(F.col("n") / 5) + 1, F.lit(ENOUGH)).cast("int")
    heavy = written(rest.filter(F.size("rest") < enough).select("nid", "n", "fam"), "heavy")
    decisive = rest.select("nid", "n", "fam", F.posexplode(F.slice("rest", F.lit(1), enough)).alias("pos", "token"))
    pairs = fitting(across(decisive.join(shared, "token", "left_semi")), nodes)

    more = ends_of(pairs).unionByName(heavy.select("nid")).distinct().join(sets.select("nid"), "nid", "left_anti")
    sets = sets.unionByName(full_sets(docs, name(more)))
    if not heavy.isEmpty():
        pairs = pairs.unionByName(fitting(rarest_first(heavy, sets), nodes))
    pairs = pairs.select("u", "v").distinct()
    links = links.unionByName(inner).unionByName(verified(pairs, sets))
    last = components(links).select(F.col("u").alias("nid"), F.col("v").alias("comp"))
    return rows, nodes.select("nid", "node").join(last, "nid", "left").select("node", F.coalesce("comp", "nid").alias("comp"))


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    component_id is the smallest doc_id of the component. A row without words, or with a null text, has no
    shingles and is alone. Rows with equal shingles are linked, repeated rows among them. A missing id is
    never the smallest. Other columns are left out.
    """
    rows, labels = linked(docs)
    ids = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    ids = ids.join(labels, "node")
    least = ids.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = ids.join(least, "comp").select("node", "component_id")
    out = rows.select("doc_id", "node", "n").join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near copies: of each component, the row with the smallest doc_id stays.

    Rows without words stay. The columns are unchanged.
    """
    rows, labels = linked(docs)
    some = rows.filter("n > 0").select("doc_id", "node").join(labels, "node")
    least = some.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("s"))
    kept = least.select(F.col("s.doc_id").alias("kept_id"), F.col("s.node").alias("kept_node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in sliced(batches):
            nodes = [node_of(s) for s in shingle_sets([t or "" for t in b["text"].to_pylist()], powers)]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(nodes, pa.binary())], ["row", "node"])

    framed = docs.select(whole_row(docs), "text")
    tagged = framed.mapInArrow(run, framed.select("row").schema.add("node", "binary"))
    wordless = tagged.filter("node is null").select("row.*")
    worded = tagged.filter("node is not null").withColumn("id", F.col("row.doc_id"))
    same = worded["id"].eqNullSafe(kept["kept_id"]) & (worded["node"] == kept["kept_node"])
    once = worded.join(kept, same).dropDuplicates(["kept_id", "kept_node"])
    return wordless.unionByName(once.select("row.*"))
