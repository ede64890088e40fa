"""Merkle manifest of a dataset by nested-interval labels.

Every node carries its tree, its level and the interval [lo, hi] of leaf ranks that it covers. A node of
level l lies in the bucket lo / fanout^l, so a child meets its parent by an equi-join on (tree, bucket) of
the parent's level, and containment of the intervals says that the two belong together. Within a parent
the interval of a node taken away from the parent's leaves its siblings: what lies to the left and what
lies to the right.

One tree for each source has the documents as leaves, one tree above them has the sources' subroots. Trees
are climbed level by level, each level a third of the one below, and the proofs come down the same way. No
step holds more than `fanout` nodes of one parent together, so a source with a third of all documents is
spread like the others. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasheaf.llm.common import sent_if_small, written
from datasheaf.operators.positions import global_index, group_index

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def framed(value: Column) -> Column:
    """A field of a leaf: `-` for null, else its bytes with their number before them."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(fields: dict[str, Column]) -> Column:
    return sha256(F.concat(*[framed(fields[f]) for f in FIELDS]))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """source, doc_id, digest and `start`, the digest of the same row with the text `tampered`."""
    fields = {f: F.col(f"`{f}`") for f in FIELDS}
    digest = leaf_hash(fields)
    start = digest if tampered is None else leaf_hash({**fields, "text": tampered})
    return docs.select("source", "doc_id", digest.alias("digest"), start.alias("start"))


def span(level: int, fanout: int) -> int:
    return fanout ** level


def families(nodes: DataFrame, level: int, fanout: int) -> DataFrame:
    """Parents of the nodes of `level` in trees that still have several of them: tree, size, lo, hi, digest, kids."""
    kid = F.struct(*[c for c in nodes.columns if c not in ("tree", "size")])
    bucket = F.expr(f"lo div {span(level + 1, fanout)}").alias("bucket")
    together = (nodes.filter(F.col("size") > span(level, fanout)).groupBy("tree", "size", bucket)
                .agg(F.array_sort(F.collect_list(kid)).alias("kids")))
    digest = sha256(F.array_join(F.transform("kids", lambda k: k["digest"]), ""))
    return together.select(
        "tree", "size", F.get("kids", F.lit(0))["lo"].alias("lo"),
        F.element_at("kids", -1)["hi"].alias("hi"), digest.alias("digest"), "kids")


def climb(nodes: DataFrame, largest: int, fanout: int, name: str) -> list[DataFrame]:
    """Families of each level from the leaves up, each a table. `nodes`: tree, size, lo, hi, digest, ..."""
    levels: list[DataFrame] = []
    while span(len(levels), fanout) < largest:
        level = written(families(nodes, len(levels), fanout), f"{name}-{len(levels)}")
        levels.append(level)
        nodes = level.drop("kids")
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame], fanout: int) -> DataFrame:
    """The one node that remains of each tree: tree, digest."""
    out = nodes.filter("size = 1").select("tree", "digest")
    for i, level in enumerate(levels):
        out = out.unionByName(level.filter(F.col("size") <= span(i + 1, fanout)).select("tree", "digest"))
    return out


STEP = "array<struct<left: string, right: string>>"


def siblings(kids: Column, lo: Column, hi: Column) -> Column:
    """Digests of the parent's interval without [lo, hi]: those to the left, those to the right."""
    def side(test) -> Column:
        return F.array_join(F.transform(F.filter(kids, test), lambda k: k["digest"]), "")
    return F.struct(side(lambda k: k["hi"] < lo).alias("left"), side(lambda k: k["lo"] > hi).alias("right"))


def descend(levels: list[DataFrame], above: DataFrame, fanout: int) -> list[DataFrame]:
    """Families of each level with `path`: the siblings of their parent node and of its ancestors, upwards.

    `above` (tree, path, ...) has one row for each tree: the path from its root on and what every node
    of the tree takes along.
    """
    extra = [c for c in above.columns if c not in ("tree", "path")]
    out: list[DataFrame] = []
    parents: DataFrame | None = None
    for level in reversed(range(len(levels))):
        own = levels[level].withColumn("bucket", F.expr(f"lo div {span(level + 2, fanout)}"))
        is_top = F.col("size") <= span(level + 1, fanout)
        found = own.filter(is_top).join(above, "tree")
        if parents is not None:
            p = parents.select(
                "tree", F.expr(f"lo div {span(level + 2, fanout)}").alias("bucket"), F.col("lo").alias("p_lo"),
                F.col("hi").alias("p_hi"), F.col("kids").alias("p_kids"), F.col("path").alias("p_path"), *extra)
            inside = own.filter(~is_top).join(p, ["tree", "bucket"]).filter("lo >= p_lo AND hi <= p_hi")
            step = F.array(siblings(F.col("p_kids"), F.col("lo"), F.col("hi")))
            found = inside.withColumn("path", F.concat(step, "p_path")).select(*found.columns).unionByName(found)
        parents = written(found.drop("bucket"), f"paths-{level}")
        out.append(parents)
    return out[::-1]


def leaf_paths(nodes: DataFrame, levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """Every leaf with what it carries, its `path` and the columns of `above`."""
    extra = [c for c in above.columns if c not in ("tree", "path")]
    carried = [c for c in nodes.columns if c not in ("tree", "size")]
    alone = nodes.filter("size = 1").join(above, "tree").select("tree", *carried, "path", *extra)
    if not levels:
        return alone
    family = descend(levels, above, fanout)[0]
    kid = family.select("tree", "kids", "path", *extra, F.explode("kids").alias("kid"))
    step = F.array(siblings(F.col("kids"), F.col("kid.lo"), F.col("kid.hi")))
    return kid.select(
        "tree", *[F.col(f"kid.{c}").alias(c) for c in carried], F.concat(step, "path").alias("path"), *extra,
    ).unionByName(alone)


def proof(path: Column) -> Column:
    """All siblings' digests, level by level upwards, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(start: Column, path: Column) -> Column:
    """Root that follows from a leaf's digest and its siblings."""
    return F.aggregate(path, start, lambda node, s: sha256(F.concat(s["left"], node, s["right"])))


class Manifest:
    """The trees over all rows of `docs`, kept as tables in the shared folder.

    Null fields are marked in the leaf, so no null meets an empty value. Rows without an id come first in
    their source, rows of one id follow by their leaf's digest (equal rows are interchangeable). Rows
    without a source form a source of their own, the first one. A lone leaf is its source's subroot, a
    lone subroot the root; both then have no siblings. Without rows there is no root. Other columns of
    `docs` take no part.
    """

    def __init__(self, docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT):
        self.fanout = fanout
        rows = written(leaves(docs, tampered), "leaves")
        sources = rows.groupBy("source").agg(F.count("*").alias("size"))
        sources = written(global_index(written(sources, "sources"), "source", out="tree"), "trees")
        count, largest = sources.agg(F.count("*"), F.max("size")).first()
        named = sent_if_small(sources.withColumnRenamed("source", "of"), count)
        ranked = group_index(rows, "source", ["doc_id", "digest"], out="lo")
        self.nodes = written(ranked.join(named, F.col("source").eqNullSafe(F.col("of"))).select(
            "tree", "size", "lo", F.col("lo").alias("hi"), "digest", "doc_id", "start"), "nodes")
        self.levels = climb(self.nodes, largest or 0, fanout, "level")
        top = written(tops(self.nodes, self.levels, fanout).select(
            F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"), F.col("tree").alias("lo"),
            F.col("tree").alias("hi"), "digest"), "subroots")
        self.sources, self.top, self.top_levels = sources, top, climb(top, count, fanout, "top")
        root = tops(top, self.top_levels, fanout).first()
        self.root: str | None = root["digest"] if root else None

    def labelled(self) -> DataFrame:
        """The manifest itself: tree (null: the one above the sources), level, lo, hi, digest of every node."""
        def table(nodes: DataFrame, levels: list[DataFrame], tree: Column) -> DataFrame:
            out = nodes.select(tree.alias("tree"), F.lit(0).alias("level"), "lo", "hi", "digest")
            for i, level in enumerate(levels):
                out = out.unionByName(level.select(tree.alias("tree"), F.lit(i + 1).alias("level"), "lo", "hi", "digest"))
            return out
        inner = table(self.nodes, self.levels, F.col("tree"))
        return inner.unionByName(table(self.top, self.top_levels, F.lit(None).cast("long")))

    def proofs(self) -> DataFrame:
        """doc_id, digest, start, subroot and `path`, the siblings of every document from its leaf up to the root."""
        none = F.array().cast(STEP)
        roof = self.top.select("tree").limit(1).withColumn("path", none)
        above = leaf_paths(self.top, self.top_levels, roof, self.fanout).select(
            F.col("lo").alias("tree"), "path", F.col("digest").alias("subroot"))
        return leaf_paths(self.nodes, self.levels, written(above, "above"), self.fanout).select(
            "doc_id", "digest", "start", "subroot", "path")


def verified(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and whether its text as `tampered` still leads to the root."""
    manifest = Manifest(docs, tampered, fanout)
    root = F.lit(manifest.root)
    rows = manifest.proofs()
    return rows.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"),
        sha256(proof(F.col("path"))).alias("proof_sha256"), folded(F.col("start"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == root)


def without_line_ends() -> Column:
    """The text, without its line ends where 2 divides the crc32 of the id."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
