"""Trie of conversations by union-find over the longest common prefixes of sorted neighbours.

Conversations are cut into chunks of CHUNK turns, each turn a digest. Chunks that follow one and the same
prefix form a group; sorted by digests, the members of every trie node stand together in it, and the turns
that a row shares with the row before it (the edge between them) say where nodes are. Edges are taken in
descending depth: each merge of two components makes a branching node at the edge's depth, or adds to the
one that is already there. Components carry sums (members, smallest id, leaves, words), so nothing is
looked up again.

A task does this for the sorted rows it has. What an unknown neighbour beyond its borders could still
change, a few components along its left and right border with rising depth, is its contracted forest;
forests of adjoining tasks are contracted together, a bounded number at a time, until one is left. A hot
first turn is only a long run of rows and is cut like any other. A conversation of any length is many
rows; groups with a single member need no trie, so there is a level of work for each CHUNK turns that
different conversations share.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import astuple, dataclass, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datasheaf.llm.common import spread_count, written
from datasheaf.operators.positions import group_index

WORD = r"[^\x20\x09-\x0D]+"
# Turns of a chunk, characters of a turn's digest, forests contracted together, rows taken at once.
CHUNK = 256
DIGEST = 32
FAN_IN = 64
ROWS = 4096
ROOT = ""


# Turns.

def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, digest, words: the turns of every conversation from 0, null turns first.

    A null role or text is empty. Turns with one number follow by role and text's digest. Rows without a
    conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(DIGEST))
    slim = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"), digest.alias("digest"), word_count(text).alias("words"))
    return group_index(written(slim, "turns"), "conv_id", ["turn", "role", "digest"], out="pos").drop("turn", "role")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Turns of conversations whose first h = crc32(conv_id) % most turns come from conv_id - conv_id % every.

    Fewer if that one has fewer, none if it is absent; then the own turns after the first h. Each
    conversation also has one row of no words before its first turn (pos -1, empty digest), so one without
    turns is still there.
    """
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = ids.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    turn = F.struct("pos", "digest", "words")
    lent = turns.filter((F.col("pos") < most - 1) & (F.col("conv_id") % every == 0)).groupBy(
        F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("lent"))
    lent_turns = F.filter(F.coalesce("lent", F.array()), lambda t: t["pos"] < F.col("h"))
    ids = ids.join(lent, "base", "left").select("conv_id", "h", lent_turns.alias("lent"))
    ids = written(ids, "conversations")
    before = F.struct(F.lit(-1).cast("long").alias("pos"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("words"))
    first = ids.select("conv_id", F.explode(F.concat(F.array(before), "lent")).alias("t")).select("conv_id", "t.*")
    shift = ids.select("conv_id", "h", (F.size("lent") - F.col("h")).alias("shift"))
    rest = turns.join(shift, "conv_id").filter("pos >= h").withColumn("pos", F.col("pos") + F.col("shift"))
    return first.unionByName(rest.select(*first.columns))


def chunked(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each `chunk` turns of a conversation.

    conv_id, chunk, prefix (identity of all turns before), next (identity with this chunk), key (the
    digests in a row), words, before (words ahead of the chunk), total (words of the conversation), last.
    Prefixes are told apart by sums of the hashes of numbered chunks, four numbers of 32 bits each.
    """
    number = F.floor(F.greatest("pos", F.lit(0)) / chunk).cast("long")
    rows = turns.groupBy("conv_id", number.alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("t"))
    rows = rows.select(
        "conv_id", "chunk", F.array_join(F.transform("t", lambda x: x["digest"]), "").alias("key"),
        F.transform(F.filter("t", lambda x: x["pos"] >= 0), lambda x: x["words"]).alias("words"))
    rows = rows.withColumn("sum", F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w))
    hashed = F.sha2(F.concat(F.col("chunk").cast("string"), F.lit(":"), F.col("key")), 256)
    rows = rows.withColumn("hash", hashed)
    own = Window.partitionBy("conv_id").orderBy("chunk")
    upto, all_rows = own.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("conv_id")
    lanes = [F.conv(F.substring("hash", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    def identity(sums: Iterable[Column]) -> Column:
        return F.concat_ws("-", *[F.hex(s) for s in sums])
    sums = [F.sum(x).over(upto) for x in lanes]
    return rows.select(
        "conv_id", "chunk",
        F.when(F.col("chunk") == 0, F.lit(ROOT)).otherwise(identity([s - x for s, x in zip(sums, lanes, strict=True)])).alias("prefix"),
        identity(sums).alias("next"), "key", "words", (F.sum("sum").over(upto) - F.col("sum")).alias("before"),
        F.sum("sum").over(all_rows).alias("total"), (F.max("chunk").over(all_rows) == F.col("chunk")).alias("last"))


# Union-find.

@dataclass
class Part:
    """A component: its top node and the sums over its members."""

    depth: int
    node: str
    words: int
    count: int
    least: int
    head: int
    total: int
    below: int
    leaves: int
    prefix: str
    before: int


@dataclass
class Edge:
    """What two neighbours share: depth (-1: nothing, not even the group), node and words at that depth."""

    depth: int
    node: str = ""
    words: int = 0


NODES = pa.schema([
    ("node", pa.string()), ("parent", pa.string()), ("depth", pa.int64()), ("parent_depth", pa.int64()),
    ("least", pa.int64()), ("head", pa.int64()), ("count", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
    ("below", pa.int64()), ("ids", pa.string()), ("part", pa.int64()), ("forest", pa.binary())])
NODE_SQL = ("node string, parent string, depth long, parent_depth long, least long, head long, count long, leaves long, "
            "saved long, below long, ids string, part long, forest binary")


def closed(p: Part, parent: str, parent_depth: int) -> dict:
    """A finished node with the unbranched stretch above it. `saved` lacks the words ahead of each depth."""
    return {"node": p.node, "parent": parent, "depth": p.depth, "parent_depth": parent_depth, "least": p.least,
            "head": p.head, "count": p.count, "leaves": max(1, p.leaves), "saved": p.total - p.below - p.words}


def top_of_group(p: Part) -> dict:
    """A group as a whole: what its rows hang below the node that ends the chunk before."""
    return {"parent": p.prefix, "least": p.least, "leaves": p.leaves, "below": p.below}


def lowered(p: Part, edge: Edge, out: list[dict]) -> Part:
    """The component seen from its ancestor at the edge's depth; the node it was is finished."""
    if p.depth == edge.depth:
        return p
    out.append(closed(p, edge.node, edge.depth))
    return replace(p, depth=edge.depth, node=edge.node, words=edge.words, below=p.below + p.words - edge.words,
                   leaves=max(1, p.leaves))


def contract(parts: list[Part], edges: list[Edge], base: int, out: list[dict], final: bool) -> tuple[list[Part], list[Edge]]:
    """Merges along the edges in descending depth. Finished nodes go to `out`; what stays open is returned.

    A component at the left border may have a deeper edge beyond it, and so has one that waits for such a
    component; the same on the right. These wait; all others are settled by their deeper edge.
    """
    n = len(parts)
    parts, up = list(parts), list(range(n))
    open_left, open_right = [False] * n, [False] * n
    if not final:
        open_left[0] = open_right[n - 1] = True
    merged = [False] * n

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in sorted((i for i in range(n - 1) if edges[i].depth >= base), key=lambda i: -edges[i].depth):
        a, b, edge = find(i), find(i + 1), edges[i]
        a_waits = open_left[a] and parts[a].depth > edge.depth
        b_waits = open_right[b] and parts[b].depth > edge.depth
        if not a_waits:
            parts[a] = lowered(parts[a], edge, out)
        if not b_waits:
            parts[b] = lowered(parts[b], edge, out)
        if a_waits or b_waits:
            open_right[a] = open_left[b] = True
            continue
        x, y = parts[a], parts[b]
        parts[a] = replace(x, count=x.count + y.count, least=min(x.least, y.least), total=x.total + y.total,
                           below=x.below + y.below, leaves=x.leaves + y.leaves)
        up[b], open_right[a], merged[i] = a, open_right[b], True

    left: list[Part] = []
    joints: list[Edge] = []
    gap = False
    for i in range(n):
        if find(i) == i:
            if open_left[i] or open_right[i]:
                if left:
                    joints.append(Edge(-1) if gap else edges[i - 1])
                left.append(parts[i])
                gap = False
            else:
                whole = lowered(parts[i], Edge(base, parts[i].prefix, parts[i].before), out)
                out.append(top_of_group(whole) if base else closed(whole, "", -1))
                gap = True
    return left, joints


@dataclass
class Border:
    """The outermost row of a forest: enough to compare it with its neighbour."""

    prefix: str
    key: str
    words: list[int]
    before: int
    following: str
    full: int

    def node_at(self, turns: int) -> str:
        """Identity of the node after so many turns of the chunk."""
        if turns == 0:
            return self.prefix
        if turns == self.full:
            return self.following
        return hashlib.blake2b(f"{self.prefix}/{self.key[:DIGEST * turns]}".encode(), digest_size=16).hexdigest()

    def edge(self, other: Border, base: int) -> Edge:
        if self.prefix != other.prefix:
            return Edge(-1)
        low, high = 0, min(len(self.words), len(other.words))
        while low < high:
            mid = (low + high + 1) // 2
            if self.key[:DIGEST * mid] == other.key[:DIGEST * mid]:
                low = mid
            else:
                high = mid - 1
        return Edge(base + low, self.node_at(low), self.before + sum(self.words[:low]))


@dataclass
class Forest:
    """Contracted components of a stretch of rows, the edges between them and the rows at its borders."""

    parts: list[Part]
    edges: list[Edge]
    first: Border
    last: Border

    def packed(self) -> bytes:
        return pickle.dumps(([astuple(p) for p in self.parts], [astuple(e) for e in self.edges], astuple(self.first), astuple(self.last)))

    @staticmethod
    def unpacked(data: bytes) -> Forest:
        parts, edges, first, last = pickle.loads(data)
        return Forest([Part(*p) for p in parts], [Edge(*e) for e in edges], Border(*first), Border(*last))


def joined(forests: Iterable[Forest], base: int, out: list[dict], final: bool) -> Forest:
    parts: list[Part] = []
    edges: list[Edge] = []
    first = last = None
    for f in forests:
        if last is not None:
            edges.append(last.edge(f.first, base))
        first = f.first if first is None else first
        parts += f.parts
        edges += f.edges
        last = f.last
    parts, edges = contract(parts, edges, base, out, final)
    return Forest(parts, edges, first, last)


def packed(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=NODES)


def planted(chunk: int, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The forest of one task's sorted rows: finished nodes, runs of ids that end in one node, and what is open."""
    base = chunk * level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Forest | None = None
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                out: list[dict] = []
                fresh = []
                ended: dict[str, list[int]] = {}
                for r in whole.slice(at, ROWS).to_pylist():
                    border = Border(r["prefix"], r["key"], r["words"], r["before"], r["next"], chunk)
                    turns = len(r["words"])
                    node = border.node_at(turns)
                    part = Part(base + turns, node, r["before"] + sum(r["words"]), 1, r["conv_id"], r["conv_id"], r["total"],
                                r["more_below"], r["more_leaves"], r["prefix"], r["before"])
                    fresh.append(Forest([part], [], border, border))
                    if r["last"]:
                        ended.setdefault(node, []).append(r["conv_id"])
                held = joined(([held] if held else []) + fresh, base, out, final=False)
                out += [{"node": k, "head": v[0], "ids": ",".join(map(str, v))} for k, v in ended.items()]
                for i in range(0, len(out), ROWS):
                    yield packed(out[i:i + ROWS])
        if held:
            yield packed([{"part": TaskContext.get().partitionId(), "forest": held.packed()}])
    return run


def regrown(base: int, final: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Adjoining forests contracted into one."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        out: list[dict] = []
        forests = rows.sort_by("part")["forest"].to_pylist()
        one = joined([Forest.unpacked(f) for f in forests], base, out, final)
        if not final:
            out.append({"part": key[0].as_py(), "forest": one.packed()})
        return pa.Table.from_batches([packed(out)])
    return run


def level_nodes(rows: DataFrame, chunk: int, level: int) -> DataFrame:
    """Nodes, groups and runs of ids of one level: a table with the columns NODES."""
    keys = ["prefix", "key", "conv_id"]
    ordered = rows.repartitionByRange(spread_count(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    tables = [written(ordered.mapInArrow(planted(chunk, level), NODE_SQL), f"trie-{level}")]
    final = False
    while not final:
        last = tables[-1].agg(F.max("part")).first()[0]
        final = last is None or last < FAN_IN
        by = F.floor(F.col("part") / FAN_IN).cast("long").alias("group")
        forests = tables[-1].filter("forest IS NOT NULL").select("part", "forest")
        tables.append(written(forests.groupBy(by).applyInArrow(regrown(chunk * level, final), NODE_SQL), f"forest-{level}"))
    out = tables[0].filter("forest IS NULL")
    for t in tables[1:]:
        out = out.unionByName(t.filter("forest IS NULL"))
    return out


# The trie.

def ended_ids(runs: DataFrame) -> DataFrame:
    """node, ends: SHA-256 of the comma-joined ascending ids that end in a node.

    The ids come as runs of text in order of their first id; a task reads them one after the other and
    keeps only the state of the hash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        done: list[tuple[str, str]] = []
        for b in batches:
            for n, ids in zip(b["node"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if n != node:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["node", "ends"])
                done = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends"])
    ordered = runs.repartition("node").sortWithinPartitions("node", "head").select("node", "ids")
    return ordered.mapInArrow(run, "node string, ends string")


def trie(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every node of the trie of conversations, given by their chunks.

    node, parent, depth, parent_depth, least, head, count, leaves, saved, ends: one row for a branching node,
    an end or a leaf together with the unbranched stretch above it. `head` is its first member in the
    order of digests.
    """
    groups = rows.filter("chunk > 0").groupBy("chunk", "prefix").agg(F.count("*").alias("members"))
    shared = written(groups.filter("members > 1").select("chunk", "prefix"), "groups")
    deepest = shared.agg(F.max("chunk")).first()[0] or 0
    tables = []
    more = None
    together = rows.join(shared, ["chunk", "prefix"], "left_semi") if deepest else None
    for level in reversed(range(deepest + 1)):
        own = rows.filter("chunk = 0") if level == 0 else together.filter(F.col("chunk") == level)
        # Below the end of a row that goes on alone there are its own words and one leaf.
        alone = ~F.col("last")
        rest = F.col("total") - F.col("before") - F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w)
        own = own.withColumns({"below": F.when(alone, rest).otherwise(F.lit(0)), "leaves": F.when(alone, F.lit(1)).otherwise(F.lit(0))})
        if more is not None:
            # Below the end of rows that go on together there is a group, counted once: at its smallest member.
            at = more.select(F.col("parent").alias("next"), F.col("least"), F.col("below").alias("g_below"), F.col("leaves").alias("g_leaves"))
            own = own.join(at, "next", "left")
            chosen = F.col("conv_id") == F.col("least")
            grouped = F.col("least").isNotNull() & ~F.col("last")
            for c in ("below", "leaves"):
                own = own.withColumn(c, F.when(grouped, F.when(chosen, F.col(f"g_{c}")).otherwise(F.lit(0))).otherwise(F.col(c)))
        own = own.select("conv_id", "prefix", "next", "key", "words", "before", "total", "last",
                         F.col("below").cast("long").alias("more_below"), F.col("leaves").cast("long").alias("more_leaves"))
        found = level_nodes(own, chunk, level)
        tables.append(found.filter("depth IS NOT NULL OR ids IS NOT NULL").withColumn("chunk", F.lit(level)))
        more = found.filter("depth IS NULL AND ids IS NULL")
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return tails(rows, shared, every, chunk)


def tails(rows: DataFrame, shared: DataFrame, found: DataFrame, chunk: int) -> DataFrame:
    """The nodes found with their ends, and the stretches that single conversations run on alone."""
    ends = ended_ids(found.filter("ids IS NOT NULL").select("node", "head", "ids"))
    nodes = found.filter("depth IS NOT NULL").join(ends, "node", "left")
    alone = rows.filter("chunk > 0").join(shared, ["chunk", "prefix"], "left_anti")
    own = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256))
    tail = alone.select(
        F.col("next").alias("node"), F.col("prefix").alias("parent"), (F.col("chunk") * chunk + F.size("words")).alias("depth"),
        (F.col("chunk") * chunk).alias("parent_depth"), F.col("conv_id").alias("least"), F.col("conv_id").alias("head"),
        F.lit(1).cast("long").alias("count"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"),
        own.alias("ends"), "chunk")
    return nodes.select(*tail.columns).unionByName(tail)


def prefix_nodes(conversations: DataFrame, rebuild: Callable[[DataFrame], DataFrame] = rebuilt, chunk: int = CHUNK) -> DataFrame:
    """One row for every distinct prefix of the rebuilt conversations, the empty one included.

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 (empty string's hash where no conversation ends). Equal conversations are members of the same nodes.
    Other columns are left out; without conversations there is no node.
    """
    rows = written(chunked(rebuild(numbered(conversations)), chunk), "chunks")
    nodes = written(trie(rows, chunk), "nodes")
    children = nodes.filter("parent_depth >= 0").groupBy(F.col("parent").alias("node"), F.col("parent_depth").alias("depth")).agg(
        F.count("*").alias("children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("depth").alias("parent_depth"), F.col("least").alias("parent_least"))
    nodes = nodes.join(children, ["node", "depth"], "left").join(above, ["parent", "parent_depth"], "left")
    # Words ahead of a depth matter only where members share them: the chunk of the first member has them.
    words = rows.select(F.col("conv_id").alias("head"), "chunk", "words", "before")
    columns = ["least", "parent_least", "count", "children", "leaves", "ends", "depth", "parent_depth", "saved"]
    depths = F.explode(F.expr("sequence(parent_depth + 1, depth)")).alias("d")
    inside = (F.col("d") - 1 - F.col("chunk") * chunk).cast("int")
    ahead = F.col("before") + F.aggregate(F.slice("words", F.lit(1), inside), F.lit(0).cast("long"), lambda a, w: a + w)
    several = nodes.filter("count > 1 AND depth > 0").join(words, ["head", "chunk"])
    shared = several.select(*columns, "words", "before", "chunk", depths).select(
        *columns, "d", (F.col("saved") - (F.col("count") - 1) * ahead).alias("saved_tokens"))
    single = nodes.filter("count = 1 AND depth > 0").select(*columns, depths).withColumn("saved_tokens", F.lit(0).cast("long"))
    root = nodes.filter("depth = 0").select(*columns, F.lit(0).cast("long").alias("d"), F.col("saved").alias("saved_tokens"))
    is_end, is_first = F.col("d") == F.col("depth"), F.col("d") == F.col("parent_depth") + 1
    children_here = F.when(is_end, F.coalesce("children", F.lit(0))).otherwise(F.lit(1)).cast("long")
    return shared.unionByName(single).unionByName(root).select(
        F.col("least").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") > 0, F.when(is_first, F.col("parent_least")).otherwise(F.col("least"))).alias("parent_conv_id"),
        F.col("count").alias("n_convs"), children_here.alias("n_children"), F.col("leaves").alias("n_leaves"), "saved_tokens",
        F.coalesce(F.when(is_end, F.col("ends")), F.sha2(F.lit(""), 256)).alias("ends_sha256"))
