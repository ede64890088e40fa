"""Detection post-processing and evaluation.

Box tables have image_id, id, x0, y0, x1, y1 (doubles) and, for predictions, score. Overlaps in images of
few boxes come from a join on the image, others from a join on grids of several cell sizes that emits only
boxes that touch. Greedy procedures
(suppression, matching) read the overlaps of one scope in order, with a bounded number of overlaps at a
time; scopes beyond that bound are cut into their connected components, and these into stretches of the
order.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from datasheaf.functions import boxes as B
from datasheaf.operators import imagepass as IP
from datasheaf.operators.graph import connected_components
from datasheaf.operators.positions import _sort_cols, group_index
from datasheaf.operators.sets import top_n_per_group
from datasheaf.session import written

# The area ranges, inclusive at both ends.
AREA_RANGES = [
    ("all", 0.0, 1e10), ("small", 0.0, 1024.0), ("medium", 1024.0, 9216.0), ("large", 9216.0, 1e10),
    ("96-128", 9216.0, 16384.0), ("128-256", 16384.0, 65536.0), ("256-512", 65536.0, 262144.0),
    ("512-inf", 262144.0, 1e10),
]
# IoU thresholds 0.50, 0.55, ..., 0.95 and the number of recall points.
IOU_THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]
RECALL_POINTS = 101

BOX = ["x0", "y0", "x1", "y1"]


def materialize(df: DataFrame) -> DataFrame:
    """A table in the shared folder: compressed and read by column, which a checkpoint is not."""
    return written(df, "detection")


# Join keys of the grids. Cells of one grid are two to the power of its level, eight times those of the one below.
_GRID = ["__level", "__cx", "__cy"]
_STEP = 3


def _sized(df: DataFrame) -> DataFrame:
    """Boxes with an area, and the power of two that their longer side does not exceed."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    solid = df.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    return solid.withColumn("__own", F.ceil(F.log2(side)).cast("int"))


def _powers(df: DataFrame) -> dict[int, int]:
    """Boxes of each power of two: as many rows as powers between the smallest and the largest box."""
    return {r[0]: r[1] for r in df.groupBy("__own").count().collect()}


def _level(power: int, offset: int) -> int:
    return -(-(power - offset) // _STEP) * _STEP + offset


def _above(own: set[int], other: set[int], least: int) -> dict[int, list[int]]:
    """For each level the levels of the other side that are higher, or (least 0) as high."""
    return {i: sorted(j for j in other if j >= i + least) for i in own}


def _looked_up(levels: dict[int, object], kind: str) -> Column:
    pairs = [x for i, v in levels.items() for x in (F.lit(i), F.lit(v).cast(kind))]
    return F.create_map(*pairs)[F.col("__own")] if pairs else F.lit(None).cast(kind)


def _listed(df: DataFrame, name: str, by: Sequence[str], level: Column) -> DataFrame:
    """Boxes under the cells of `level` that they cover; at most four where the level is their own or higher."""
    size = F.pow(F.lit(2.0), F.col("__level"))
    held = [c for c in df.columns if c not in (*by, "__own")]

    def cells(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))

    at = df.select(*by, F.struct(*held).alias(name), *BOX, level.alias("__level"))
    across = at.select(*by, name, "__level", "y0", "y1", F.explode(cells("x0", "x1")).alias("__cx"))
    return across.select(*by, name, "__level", "__cx", F.explode(cells("y0", "y1")).alias("__cy"))


# Boxes of a scope on one side that are all compared with those on the other side.
FEW_BOXES = 64


def overlapping_pairs(a: DataFrame, b: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """`by`, structs `a` and `b`, `iou` of every pair with a positive overlap. Boxes without an area overlap nothing.

    Scopes of at most FEW_BOXES boxes on each side are joined whole; the boxes of others meet in grid cells.
    """
    many = [x.groupBy(*by).count().filter(F.col("count") > FEW_BOXES).select(*by) for x in ((a,) if a is b else (a, b))]
    if all(x.isEmpty() for x in many):
        return _all_pairs(a, b, by)
    crowded = written(functools.reduce(DataFrame.unionByName, many).distinct(), "crowded")
    few = [x.join(crowded, [*by], "left_anti").select(x.columns) for x in (a, b)]
    rest = [x.join(crowded, [*by], "left_semi").select(x.columns) for x in ((a,) if a is b else (a, b))]
    return _all_pairs(*few, by).unionByName(_grid_pairs(rest[0], rest[-1], by))


def _crowd(b: DataFrame) -> Column | None:
    return F.col("b.iscrowd") == 1 if "iscrowd" in b.columns else None


def _all_pairs(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Overlaps from a join on `by`: as many comparisons as pairs of boxes.

    Boxes are joined as plain columns with their size, and the overlap is worked out once for its test and
    once for the ratio: nested in structs and repeated, the expressions took eight times as long.
    """
    def boxes(df: DataFrame, name: str) -> DataFrame:
        solid = df.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
        size = B.area(*[F.col(c) for c in BOX]).alias(f"__{name}_size")
        return solid.select(*by, size, *[F.col(c).alias(f"__{name}_{c}") for c in df.columns if c not in by])

    def row(df: DataFrame, name: str) -> Column:
        return F.struct(*[F.col(f"__{name}_{c}").alias(c) for c in df.columns if c not in by]).alias(name)

    def side(lo: str, hi: str) -> Column:
        return F.greatest(F.least(f"__a_{hi}", f"__b_{hi}") - F.greatest(f"__a_{lo}", f"__b_{lo}"), F.lit(0.0))

    met = boxes(a, "a").join(boxes(b, "b"), [*by]).withColumn("__both", side("x0", "x1") * side("y0", "y1")).filter("__both > 0")
    union = F.col("__a_size") + F.col("__b_size") - F.col("__both")
    if "iscrowd" in b.columns:
        union = F.when(F.col("__b_iscrowd") == 1, F.col("__a_size")).otherwise(union)
    iou = F.when(F.col("__union") > 0, F.col("__both") / F.col("__union")).otherwise(F.lit(0.0))
    return met.withColumn("__union", union).select(*by, row(a, "a"), row(b, "b"), iou.alias("iou"))


def _grid_pairs(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Overlaps from a join on grid cells.

    A box belongs to the grid whose cells are next above its longer side, and two boxes meet on (by, cell)
    in the grid of the larger one, where the smaller one is listed as well. So a huge box does not cover
    thousands of small cells, and small boxes meet each other only in small cells. A pair is kept in the
    one cell that holds the lower corner of its overlap, so nothing has to be deduplicated.
    """
    crowd = _crowd(b)
    one = a is b
    a, b = _sized(a), _sized(b)
    of_a = _powers(a)
    of_b = of_a if one else _powers(b)

    def lifted(offset: int) -> int:
        """Rows that have to be listed in grids above their own."""
        return sum(n * len({_level(q, offset) for q in y} - set(range(-10**4, _level(p, offset) + 1)))
                   for x, y in ((of_a, of_b), (of_b, of_a)) for p, n in x.items())

    offset = min(range(_STEP), key=lifted)
    in_a, in_b = ({_level(p, offset) for p in x} for x in (of_a, of_b))
    a = a.withColumn("__own", _looked_up({p: _level(p, offset) for p in of_a}, "int"))
    b = b.withColumn("__own", _looked_up({p: _level(p, offset) for p in of_b}, "int"))
    own = F.col("__own")
    here_or_above = F.explode(_looked_up(_above(in_b, in_a, 0), "array<int>"))
    above = F.explode(_looked_up(_above(in_a, in_b, 1), "array<int>"))
    met = _listed(a, "a", by, own).join(_listed(b, "b", by, here_or_above), [*by, *_GRID])
    if any(_above(in_a, in_b, 1).values()):
        met = met.unionByName(_listed(a, "a", by, above).join(_listed(b, "b", by, own), [*by, *_GRID]))
    size = F.pow(F.lit(2.0), F.col("__level"))
    corner = (F.floor(F.greatest("a.x0", "b.x0") / size) == F.col("__cx")) & (
        F.floor(F.greatest("a.y0", "b.y0") / size) == F.col("__cy")
    )
    return met.filter(corner & (B.intersection("a", "b") > 0)).select(*by, "a", "b", B.iou("a", "b", crowd).alias("iou"))


# Overlaps that one task reads in order, with what it has decided so far in memory.
MAX_EDGES = 200_000


def _read_in_order(edges: DataFrame, scope: Sequence[str], keys: Sequence[str], decide) -> DataFrame:
    """Edges that `decide` accepts, read scope by scope in the order of `__o`.

    `decide()` gives a fresh function of a row's `keys` for each scope. Of edges with `__slots` it gives the
    bits that it accepts. The order is not among the columns of the result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, accept = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for c in scope:
                new[1:] |= np.diff(batch[c].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)) != 0
            first, last = (tuple(batch[c][i].as_py() for c in scope) for i in (0, batch.num_rows - 1))
            new[0] = accept is None or first != here
            here, mask = last, []
            for starts, *row in zip(new.tolist(), *[_values(batch[c]) for c in keys], strict=True):
                if starts:
                    accept = decide()
                mask.append(accept(*row))
            if "__slots" in keys:
                at = batch.schema.get_field_index("__slots")
                batch = batch.set_column(at, batch.schema.field(at), pa.array(mask, pa.int64()))
                mask = np.array(mask, np.int64) != 0
            yield batch.filter(pa.array(mask, pa.bool_()))

    ordered = edges.repartition(*scope).sortWithinPartitions(*scope, "__o").drop("__o")
    return ordered.mapInArrow(run, ordered.schema)


def _values(column: pa.Array) -> list:
    plain = pa.types.is_integer(column.type) or pa.types.is_boolean(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if plain and not column.null_count else column.to_pylist()


def in_order(
    edges: DataFrame, scope: Sequence[str], keys: Sequence[str], nodes: tuple[Column, Column], decide, strike,
    limit: int | None = None,
) -> DataFrame:
    """Edges chosen by a procedure that goes through the edges of each scope in the order of `__o`.

    A scope of at most `limit` edges is read by one task. A larger one is cut into the connected
    components of its edges (`nodes`: the two ends of an edge, told apart across scopes). Of a component
    that is still larger, the edges up to the `limit`-th one and those of equal `__o.k` are settled, what
    they decide is struck from the rest by `strike(rest, chosen, scope)`, and so on: at most 2 + edges /
    limit rounds.
    """
    limit = limit or MAX_EDGES
    counts = materialize(edges.groupBy(*scope).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit))
    if counts.isEmpty():
        return _read_in_order(edges, scope, keys, decide)
    done = _read_in_order(_without(edges, counts, scope), scope, keys, decide)
    rest = _within(edges, counts, scope).withColumns({"__u": nodes[0], "__v": nodes[1]})
    rest = materialize(rest)
    part = connected_components(rest.select(F.col("__u").alias("u"), F.col("__v").alias("v")))
    part = part.select(F.col("node").alias("__u"), F.col("component").alias("__part"))
    rest = materialize(rest.join(part, "__u").select(*edges.columns, "__part"))
    inner = [*scope, "__part"]
    while not rest.isEmpty():
        ranked = group_index(rest, inner, "__o", "__at")
        cut = ranked.filter(F.col("__at") < limit).groupBy(*inner).agg(F.max("__o.k").alias("__k"))
        near = rest.join(cut, inner).withColumn("__now", F.col("__o.k") <= F.col("__k")).drop("__k")
        near = materialize(near)
        chosen = materialize(_read_in_order(near.filter("__now").drop("__now"), inner, keys, decide))
        done = done.unionByName(chosen.drop("__part"))
        rest = materialize(strike(near.filter("NOT __now").drop("__now").select(*edges.columns, "__part"), chosen, inner))
    return done


def _same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    tests = [left[c].eqNullSafe(right[c]) for c in cols]
    return functools.reduce(lambda x, y: x & y, tests)


def _without(df: DataFrame, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.join(other, _same(df, other, cols), "left_anti")


def _within(df: DataFrame, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.join(other, _same(df, other, cols), "left_semi")


FIRST_TIER, TIER_GROWTH = 256, 8


def nms(
    df: DataFrame, iou: float, by: Sequence[str] = ("image_id",), first_tier: int = FIRST_TIER
) -> DataFrame:
    """Boxes that survive greedy suppression: best score first (smaller id on ties), drop what
    overlaps a kept box by more than `iou`.

    Boxes are taken in tiers of their rank inside the image, each tier `TIER_GROWTH` times the one
    before. What a kept box of an earlier tier suppresses never meets the other boxes of its own
    tier, so a crowded image costs about kept x boxes, not boxes x boxes.
    """
    slim = materialize(df.select(*by, "id", "score", *BOX))  # read several times below
    largest = slim.groupBy(*by).count().agg(F.max("count")).first()[0]
    if largest is None:
        return df
    if largest <= first_tier:
        return _keep(df, _suppressed(slim, iou, by), by)
    slim = materialize(group_index(slim, list(by), ["-score", "id"], "__rank"))
    kept, lo, hi = None, 0, first_tier
    while lo < largest:
        tier = slim.filter((F.col("__rank") >= lo) & (F.col("__rank") < hi)).drop("__rank")
        if kept is not None:
            hit = overlapping_pairs(kept, tier, by).filter(F.col("iou") > iou)
            tier = materialize(_keep(tier, hit.select(*by, F.col("b.id").alias("id")), by))
        tier = materialize(_keep(tier, _suppressed(tier, iou, by), by))
        kept = tier if kept is None else kept.unionByName(tier)
        lo, hi = hi, hi * TIER_GROWTH
    return df.join(kept.select(*by, "id"), [*by, "id"], "left_semi")


def _keep(df: DataFrame, dropped: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(dropped, [*by, "id"], "left_anti")


class _Suppression:
    """Best box first: a box drops the worse ones it overlaps unless it was dropped itself."""

    def __init__(self):
        self.dropped = set()

    def __call__(self, better, worse) -> bool:
        if better in self.dropped:
            return False
        self.dropped.add(worse)
        return True


def _suppressed(slim: DataFrame, iou: float, by: Sequence[str]) -> DataFrame:
    """Ids that greedy suppression drops among the given boxes."""
    better = (F.col("a.score") > F.col("b.score")) | (
        (F.col("a.score") == F.col("b.score")) & (F.col("a.id") < F.col("b.id"))
    )
    rank = F.struct((-F.col("a.score")).alias("s"), F.col("a.id").alias("i"))
    edges = overlapping_pairs(slim, slim, by).filter((F.col("iou") > iou) & better).select(
        *by, F.col("a.id").alias("hi"), F.col("b.id").alias("lo"), F.struct(rank.alias("k"), F.col("b.id").alias("l")).alias("__o")
    )

    def strike(rest: DataFrame, chosen: DataFrame, scope: Sequence[str]) -> DataFrame:
        out = chosen.select(*scope, F.col("lo").alias("__x")).distinct()
        for end in ("hi", "lo"):
            rest = _without(rest.withColumnRenamed(end, "__x"), out, [*scope, "__x"]).withColumnRenamed("__x", end)
        return rest

    nodes = F.xxhash64(*by, "hi"), F.xxhash64(*by, "lo")
    chosen = in_order(materialize(edges), by, ["hi", "lo"], nodes, _Suppression, strike)
    return chosen.select(*by, F.col("lo").alias("id")).distinct()


class _Matching:
    """Best edge first: chosen when both ends are free; a shared right end is always free."""

    def __init__(self):
        self.left, self.right = set(), set()

    def __call__(self, left, right, shared) -> bool:
        if left in self.left or (not shared and right in self.right):
            return False
        self.left.add(left)
        self.right.add(right)
        return True


class _SlotMatching:
    """As `_Matching` in many slots at once: the bits of the edge's slots in which both ends are free."""

    def __init__(self):
        self.left, self.right = {}, {}

    def __call__(self, left, right, shared, slots) -> int:
        used = self.left.get(left, 0)
        held = self.right.get(right, 0)
        free = slots & ~used if shared else slots & ~(used | held)
        if free:
            self.left[left] = used | free
            self.right[right] = held | free
        return free


def _less(rest: DataFrame, gone: DataFrame, inner: Sequence[str], end: str) -> DataFrame:
    """Edges without the slots that are `gone` for their node at one end; none without slots."""
    names = {c: f"__g{i}" for i, c in enumerate([*inner, end])}
    taken = gone.groupBy(*[F.col(c).alias(g) for c, g in names.items()]).agg(F.bit_or("__slots").alias("__gone"))
    same = functools.reduce(lambda x, y: x & y, [rest[c].eqNullSafe(taken[g]) for c, g in names.items()])
    left = F.col("__slots").bitwiseAND(F.bitwise_not(F.coalesce("__gone", F.lit(0).cast("long"))))
    return rest.join(taken, same, "left").withColumn("__slots", left).select(rest.columns).filter("__slots <> 0")


def ordered_matching(
    edges: DataFrame, scope: Sequence[str], left: str, right: str, first: Column, then: Column,
    shared: Column | None = None,
) -> DataFrame:
    """Edges chosen by a greedy one-to-one matching that takes them in the order of (`first`, `then`).

    `first` orders the turns (all edges of equal `first` have one left node), `then` the edges of a turn.
    `shared` marks edges whose right node may be chosen any number of times. Edges with a column `__slots`
    (long) are matched in each of its bits by itself; the chosen edges have the bits in which they were.
    """
    # The order repeats columns of the edges, so it is not written with them.
    e = materialize(edges).withColumn("__o", F.struct(first.alias("k"), then.alias("l"))).withColumn(
        "__s", shared if shared is not None else F.lit(False)
    )

    def strike(rest: DataFrame, chosen: DataFrame, inner: Sequence[str]) -> DataFrame:
        if "__slots" in edges.columns:
            return _less(_less(rest, chosen, inner, left), chosen.filter("NOT __s"), inner, right)
        taken = chosen.select(*inner, F.col(left).alias("__x")).distinct()
        rest = _without(rest.withColumnRenamed(left, "__x"), taken, [*inner, "__x"]).withColumnRenamed("__x", left)
        used = chosen.filter("NOT __s").select(*inner, F.col(right).alias("__x")).distinct()
        return _without(rest.withColumnRenamed(right, "__x"), used, [*inner, "__x"]).withColumnRenamed("__x", right)

    nodes = F.xxhash64(*scope, F.lit("l"), left), F.xxhash64(*scope, F.lit("r"), right)
    if "__slots" in edges.columns:
        return in_order(e, scope, [left, right, "__s", "__slots"], nodes, _SlotMatching, strike).drop("__o", "__s")
    return in_order(e, scope, [left, right, "__s"], nodes, _Matching, strike).drop("__o", "__s")


def greedy_match(pairs: DataFrame, scope: Sequence[str] = ("image_id",)) -> DataFrame:
    """Repeatedly the pair with the largest IoU among unused boxes: `scope`, pred, gt, iou.

    `pairs`: scope, pred, gt, iou. Equal overlaps go to the smaller gt, then the smaller pred.
    """
    order = F.struct((-F.col("iou")).alias("i"), F.col("gt").alias("g"), F.col("pred").alias("p"))
    return ordered_matching(pairs, scope, "gt", "pred", order, F.lit(0))


def mean_best_iou(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: mean over targets of the best IoU with a prediction, 0 when there is none."""
    best = pairs.groupBy("image_id", F.col("b.id").alias("id")).agg(F.max("iou").alias("best"))
    j = targets.select("image_id", "id").join(best, ["image_id", "id"], "left")
    return j.agg(F.avg(F.coalesce("best", F.lit(0.0))).alias("mean_best_iou"))


def best_proposals(proposals: DataFrame, limit: int) -> DataFrame:
    return top_n_per_group(proposals, ["image_id"], ["-score", "id"], limit)


def proposal_recall(
    proposals: DataFrame, gt: DataFrame, limits: Sequence[int] = (100, 1000),
    areas: Sequence[str] = ("all", "small", "medium", "large"), thresholds: Sequence[float] = tuple(IOU_THRESHOLDS),
) -> DataFrame:
    """`area`, `lim`, `threshold`, `hits`, `num_pos`, `recall`.

    Crowd regions are left out; images without proposals or without other ground truth are left out
    with all their boxes; proposals are cut to the limit by score. The average recall is the mean
    over thresholds.
    """
    bounds = {n: (lo, hi) for n, lo, hi in AREA_RANGES}
    proposals, gt = materialize(proposals), materialize(gt)  # both are read several times
    gt = gt.filter(F.coalesce("iscrowd", F.lit(0)) == 0).join(
        proposals.select("image_id").distinct(), "image_id", "left_semi"
    )
    bands = [(n, *bounds[n]) for n in areas]
    from datasheaf.operators.joins import matched_in_bands

    banded = gt.withColumn("area_name", F.explode(matched_in_bands(F.col("area"), bands)))
    totals = banded.groupBy(F.col("area_name").alias("area")).agg(F.count(F.lit(1)).alias("num_pos"))
    # One list cut to the largest limit; a proposal belongs to every limit its rank is within. Limits that hold all
    # proposals of an image give the same matches: they are made once, for the smallest of them.
    limits = sorted(limits)
    ranked = top_n_per_group(proposals, ["image_id"], ["-score", "id"], max(limits), rank="rank")
    listed = F.max("rank").over(Window.partitionBy("image_id"))
    ranked = ranked.withColumn("enough", F.array_min(F.filter(F.lit(limits), lambda x: x >= listed)))
    pairs = overlapping_pairs(
        ranked.select("image_id", "id", "rank", "enough", *BOX), gt.select("image_id", "id", "area", *BOX)
    ).filter(F.col("iou") > 0)
    long = pairs.select(
        "image_id", F.col("a.id").alias("pred"), F.col("b.id").alias("gt"), "iou",
        F.explode(matched_in_bands(F.col("b.area"), bands)).alias("area"), F.col("a.rank").alias("rank"),
        F.col("a.enough").alias("enough"),
    ).withColumn("lim", F.explode(F.filter(F.lit(limits), lambda x: (F.col("rank") <= x) & (x <= F.col("enough")))))
    matched = greedy_match(long.drop("rank"), ["image_id", "area", "lim"])
    same = F.filter(F.lit(limits), lambda x: (x == F.col("lim")) | ((x > F.col("enough")) & (F.col("lim") == F.col("enough"))))
    matched = matched.withColumn("lim", F.explode(same)).drop("enough")
    return recall_from_overlaps(matched, totals, limits, thresholds)


def recall_from_overlaps(
    matched: DataFrame, totals: DataFrame, limits: Sequence[int], thresholds: Sequence[float]
) -> DataFrame:
    """Recall table from matched overlaps (area, lim, iou) and positives per area (area, num_pos)."""
    grid = totals.withColumn("lim", F.explode(F.lit(list(limits)))).withColumn(
        "threshold", F.explode(F.lit(list(thresholds)))
    )
    hits = matched.withColumn(
        "threshold", F.explode(F.filter(F.lit(list(thresholds)), lambda t: F.col("iou") >= t))
    ).groupBy("area", "lim", "threshold").agg(F.count(F.lit(1)).alias("hits"))
    out = grid.join(hits, ["area", "lim", "threshold"], "left").fillna(0, ["hits"])
    return out.withColumn("recall", F.col("hits") / F.col("num_pos"))


def _least_iou(t: Column) -> Column:
    return F.least(t, F.lit(1 - 1e-10))


# Slots (areas x thresholds) that fit into the bits of one long.
MAX_SLOTS = 62


def coco_matches(
    dets: DataFrame, gt: DataFrame, thresholds: Sequence[float], areas: Sequence[str] = ("all",),
    max_dets: int | None = 100, pairs: DataFrame | None = None,
) -> DataFrame:
    """One row per detection: image_id, category_id, id, score, and `counted` and `hits`, bit sets
    over (area, threshold): bit a * len(thresholds) + t.

    `gt`: image_id, category_id, id, box, area, iscrowd. Detections take, best score first, the free
    ground truth of largest overlap at or above the threshold; one that counts before one that is
    ignored (crowd, or area out of range); a crowd region serves any number of them. A detection on
    ignored ground truth, or unmatched with its own area out of range, does not count; one on other
    ground truth is a hit. `pairs` replaces box overlaps by other similarities (image_id,
    category_id, a, b, iou).

    A detection and a ground truth that overlap nothing else match at every threshold below their
    IoU; the other overlaps are matched in order, in the bits of all (area, threshold) at once.
    """
    by = ["image_id", "category_id"]
    bands = [r for r in AREA_RANGES if r[0] in areas]
    nt = len(thresholds)
    if nt * len(bands) > MAX_SLOTS:
        raise ValueError(f"at most {MAX_SLOTS} pairs of area and threshold at a time")
    least = [min(float(t), 1 - 1e-10) for t in thresholds]

    def bits(of_band) -> Column:
        """Sum over the bands of a bit set over thresholds, moved to the band's place."""
        parts = [of_band(lo, hi) * F.lit(1 << (a * nt)) for a, (_, lo, hi) in enumerate(bands)]
        return sum(parts[1:], parts[0])

    top = dets if max_dets is None else top_n_per_group(dets, by, ["-score", "id"], max_dets)
    sized = top.withColumn("area", B.area(*[F.col(c) for c in BOX])) if "area" not in top.columns else top
    if pairs is None:
        pairs = overlapping_pairs(
            sized.select(*by, "id", "score", *BOX), gt.select(*by, "id", "area", "iscrowd", *BOX), by
        )
    edges = materialize(pairs.filter(F.col("iou") >= min(least)).select(
        *by, F.col("a.id").alias("det"), F.col("a.score").alias("score"), F.col("b.id").alias("gt"),
        (F.coalesce("b.iscrowd", F.lit(0)) == 1).alias("crowd"), F.col("b.area").alias("gt_area"), "iou",
    ))
    one_det = edges.groupBy(*by, "det").agg(F.count(F.lit(1)).alias("__d"))
    one_gt = edges.groupBy(*by, "gt").agg(F.count(F.lit(1)).alias("__g"))
    ranked = edges.join(one_det, [*by, "det"]).join(one_gt, [*by, "gt"])
    alone = (F.col("__d") == 1) & (F.col("__g") == 1)

    reached = [F.when(F.col("iou") >= t, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, t in enumerate(least)]
    reach = sum(reached[1:], reached[0])
    zero = F.lit(0).cast("long")

    def serves(lo: float, hi: float) -> Column:
        return ~F.col("crowd") & F.col("gt_area").between(lo, hi)

    simple = ranked.filter(alone).select(
        *by, F.col("det").alias("id"), bits(lambda lo, hi: F.when(serves(lo, hi), reach).otherwise(zero)).alias("hit"),
        bits(lambda lo, hi: F.when(serves(lo, hi), zero).otherwise(reach)).alias("ignored"),
    )
    # Once for the slots in which the ground truth counts, once for those in which it is ignored. One without an
    # area is neither.
    unsized = F.col("gt_area").isNull() & ~F.col("crowd")
    every = bits(lambda lo, hi: reach)
    served = bits(lambda lo, hi: F.when(serves(lo, hi), reach).otherwise(zero))
    kinds = F.when(unsized, F.array(F.struct(F.lit(None).cast("boolean").alias("ignored"), every.alias("slots")))).otherwise(F.array(
        F.struct(F.lit(False).alias("ignored"), served.alias("slots")),
        F.struct(F.lit(True).alias("ignored"), every.bitwiseAND(F.bitwise_not(served)).alias("slots")),
    ))
    tangled = ranked.filter(~alone).withColumn("kind", F.explode(F.filter(kinds, lambda x: x["slots"] != 0))).select(
        *by, "det", "score", "gt", "crowd", "iou", F.col("kind.ignored").alias("ignored"), F.col("kind.slots").alias("__slots"),
    )
    # Larger overlap first; of equal ones the later ground truth wins, hence the descending id.
    left = F.struct(F.col("ignored"), (-F.col("iou")).alias("i"), (-F.col("gt")).alias("g"))
    right = F.struct((-F.col("score")).alias("s"), F.col("det"))
    rounds = ordered_matching(tangled, by, "det", "gt", right, left, F.col("crowd")).groupBy(
        *by, F.col("det").alias("id")
    ).agg(
        F.coalesce(F.bit_or(F.when(~F.col("ignored"), F.col("__slots"))), zero).alias("hit"),
        F.coalesce(F.bit_or(F.when(F.col("ignored"), F.col("__slots"))), zero).alias("ignored"),
    )
    taken = simple.unionByName(rounds)  # a detection is alone or not: one row each
    full = F.lit((1 << nt) - 1).cast("long")
    own = bits(lambda lo, hi: F.when(F.col("area").between(lo, hi), full).otherwise(zero))
    hit, ignored = F.coalesce("hit", zero), F.coalesce("ignored", zero)
    return sized.select(*by, "id", "score", own.alias("own")).join(taken, [*by, "id"], "left").select(
        *by, "id", "score", F.col("own").bitwiseOR(hit).bitwiseAND(F.bitwise_not(ignored)).alias("counted"),
        hit.alias("hits"),
    )


def ground_truth_counts(gt: DataFrame, areas: Sequence[str]) -> DataFrame:
    """`category_id`, `area`, `npos`: ground truth that counts."""
    from datasheaf.operators.joins import matched_in_bands

    bands = [r for r in AREA_RANGES if r[0] in areas]
    return gt.filter(F.coalesce("iscrowd", F.lit(0)) == 0).withColumn(
        "area", F.explode(matched_in_bands(F.col("area"), bands))
    ).groupBy("category_id", "area").agg(F.count(F.lit(1)).alias("npos"))


# Detections in one range of the order, sorted by one task.
ROWS_IN_ORDER = 500_000


def _bits(values: np.ndarray, n: int) -> np.ndarray:
    """Rows by slots: the lowest `n` bits of each number."""
    return (values[:, None] >> np.arange(n)) & 1


def _lists(values: np.ndarray) -> pa.Array:
    rows, n = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * n, pa.int32()), pa.array(values.ravel()))


def _numbers(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch[name][i].values.to_numpy(zero_copy_only=False)


def _stretches(n: int, kept: Sequence[str]):
    """Ordered rows as a row for each stretch of one category in a batch, with its sums by slot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = 0
        for b in batches:
            if not b.num_rows:
                continue
            code = b["category_id"].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.append(0, np.flatnonzero(np.diff(code)) + 1)
            ends = pa.array(np.append(starts, b.num_rows), pa.int32())
            sums = {c: np.add.reduceat(_bits(b[c].to_numpy(zero_copy_only=False), n), starts) for c in ("hits", "counted")}
            yield pa.RecordBatch.from_arrays(
                [b["category_id"].take(pa.array(starts)), b["__range"].take(pa.array(starts)), pa.array(np.arange(first, first + len(starts))),
                 *[_lists(sums[c]) for c in ("hits", "counted")], *[pa.ListArray.from_arrays(ends, b[c]) for c in ("hits", "counted", *kept)]],
                names=["category_id", "__range", "__no", "__hits", "__counted", "hits", "counted", *kept])
            first += len(starts)
    return run


def precision_recall(
    matches: DataFrame, npos: DataFrame, thresholds: Sequence[float], areas: Sequence[str] = ("all",),
    keep: Sequence[str] = (),
) -> DataFrame:
    """The curve of each category, area and threshold, best score first, in stretches of one category.

    A row is a stretch of a few thousand detections: `hits` and `counted` of each, their sums by slot before
    the stretch (`hits_before`, `counted_before`), `npos` by area (NULL: no ground truth), `areas`, and of
    the columns `keep` an array each. `curve_rows` gives a row for each hit.

    Detections are ordered once, in ranges of ROWS_IN_ORDER rows, so a frequent category is not one task;
    what the stretches before hold comes from a row for each stretch. `matches` is read several times.
    """
    n = len(thresholds) * len(areas)
    zero = F.lit(0).cast("long")
    slim = matches.select("category_id", "score", "image_id", "id", *[F.coalesce(c, zero).alias(c) for c in ("hits", "counted")])
    order = [F.col("category_id").asc(), *_sort_cols(BEST_FIRST)]
    dealt = slim.repartitionByRange(max(1, -(-matches.count() // ROWS_IN_ORDER)), *order).sortWithinPartitions(*order)
    kind = _stretch_columns(slim, keep)
    rows = dealt.select("category_id", "hits", "counted", *keep, F.spark_partition_id().alias("__range"))
    return _with_sums(written(rows.mapInArrow(_stretches(n, keep), kind), "stretches"), npos, n, areas)


# Order of the detections of a category.
BEST_FIRST = [("score", True), ("image_id", False), ("id", False)]


def class_curve(matches: DataFrame, npos: DataFrame, listed: dict) -> DataFrame:
    """As `precision_recall` for one slot, from detections with a bit for each category that their class counts for (`listed`).

    Detections are ordered once, whatever their class, and told apart by category as they are cut into stretches.
    """
    order = _sort_cols(BEST_FIRST)
    dealt = matches.repartitionByRange(max(1, -(-matches.count() // ROWS_IN_ORDER)), *order).sortWithinPartitions(*order)
    kind = _stretch_columns(matches)
    rows = dealt.select("category_id", "hits", "counted", "kind", F.spark_partition_id().alias("__range"))
    run = IP.class_stretches(listed, to_arrow_type(kind["category_id"].dataType), kind.names)
    return _with_sums(written(rows.mapInArrow(run, kind), "stretches"), npos, 1, ["all"])


def _stretch_columns(matches: DataFrame, keep: Sequence[str] = ()) -> T.StructType:
    long, whole = T.ArrayType(T.LongType()), T.LongType()
    return T.StructType([
        T.StructField("category_id", matches.schema["category_id"].dataType), T.StructField("__range", T.IntegerType()), T.StructField("__no", whole),
        *[T.StructField(c, long) for c in ("__hits", "__counted", "hits", "counted")],
        *[T.StructField(c, T.ArrayType(matches.schema[c].dataType)) for c in keep],
    ])


def _with_sums(table: DataFrame, npos: DataFrame, n: int, areas: Sequence[str]) -> DataFrame:
    """Stretches with the sums by slot of those before them, and the positives of their category."""
    zero = F.lit(0).cast("long")
    by = Window.partitionBy("category_id").orderBy("__range", "__no").rowsBetween(Window.unboundedPreceding, -1)
    before = table.select("__range", "__no", *[
        F.array(*[F.coalesce(F.sum(F.get(f"__{c}", F.lit(k))).over(by), zero) for k in range(n)]).alias(f"{c}_before") for c in ("hits", "counted")
    ])
    of_area = [F.max(F.when(F.col("area") == a, F.col("npos"))) for a in areas]
    found = npos.groupBy("category_id").agg(F.array(*of_area).alias("npos"))
    return table.drop("__hits", "__counted").join(before, ["__range", "__no"]).join(found, "category_id").withColumn("areas", F.lit(list(areas)))


def _slots(batch: pa.RecordBatch, i: int, nt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a stretch, rows by slots: what is a hit, hits and counted detections up to the row; positives by slot."""
    npos = np.repeat(batch["npos"][i].values.to_numpy(zero_copy_only=False).astype(float), nt)
    hit, counted = (_bits(_numbers(batch, c, i), len(npos)) for c in ("hits", "counted"))
    tps = hit.cumsum(axis=0) + _numbers(batch, "hits_before", i)
    seen = counted.cumsum(axis=0) + _numbers(batch, "counted_before", i)
    return (hit == 1) & ~np.isnan(npos), tps, seen, npos


def _by_stretch(curve: DataFrame, nt: int, columns: str, of_stretch, thresholds: Sequence[float] = (), reads: Sequence[str] = ()) -> DataFrame:
    """Rows that `of_stretch(batch, i, hit, tps, seen, npos)` gives as arrays (slots first), with their category, area and threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                slot, *rest = of_stretch(b, i, *_slots(b, i, nt))
                names = pa.array(b["areas"][i].as_py()).take(pa.array(slot // nt))
                at = pa.array(np.asarray(thresholds, float)[slot % nt])
                same = b["category_id"].take(pa.array(np.full(len(slot), i)))
                yield pa.RecordBatch.from_arrays([same, names, at, *[x if isinstance(x, pa.Array) else pa.array(x) for x in rest]], names=kind.names)

    kind = T.StructType([
        T.StructField("category_id", curve.schema["category_id"].dataType), T.StructField("area", T.StringType()),
        T.StructField("threshold", T.DoubleType()), *T.StructType.fromDDL(columns).fields,
    ])
    needed = ["category_id", "areas", "hits", "counted", "hits_before", "counted_before", "npos", *reads]
    return curve.select(*needed).mapInArrow(run, kind)


def curve_rows(curve: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """`precision` and `recall` at every hit: category_id, area, threshold, score, image_id, id, npos.

    `curve`: from `precision_recall` with `keep` of score, image_id, id. Precision falls between hits, so the
    rows left out never matter.
    """
    keys = ["score", "image_id", "id"]

    def of_stretch(b, i, hit, tps, seen, npos):
        slot, row = np.nonzero(hit.T)
        t = tps[row, slot]
        held = [b[c][i].values.take(pa.array(row)) for c in keys]
        return slot, *held, t / seen[row, slot], npos[slot].astype(np.int64), t / npos[slot]

    kinds = ", ".join(f"{c} {curve.schema[c].dataType.elementType.simpleString()}" for c in keys)
    return _by_stretch(curve, len(thresholds), f"{kinds}, precision double, npos long, recall double", of_stretch, thresholds, keys)


def interpolated_ap(curve: DataFrame, npos: DataFrame, thresholds: Sequence[float], points: int = RECALL_POINTS) -> DataFrame:
    """`category_id`, `area`, `threshold`, `ap`: mean over the recall points of the best precision at
    that recall or beyond.

    A hit reaches its recall points by count, so each stretch and each group shrink to at most `points` + 1 maxima.
    """
    group = ["category_id", "area", "threshold"]
    step = 1.0 / (points - 1)

    def of_stretch(b, i, hit, tps, seen, npos):
        slot, row = np.nonzero(hit.T)
        t = tps[row, slot]
        recall = t / npos[slot]
        # The estimate can be off by one where i * step rounds; the exact test settles it.
        guess = np.floor(recall * (points - 1))
        reached = guess + 1 - (guess * step > recall) + (((guess + 1) * step <= recall) & (guess + 1 < points))
        if not len(slot):
            return slot, reached.astype(np.int64), recall
        first = np.append(0, np.flatnonzero((np.diff(slot) != 0) | (np.diff(reached) != 0)) + 1)
        return slot[first], reached[first].astype(np.int64), np.maximum.reduceat(t / seen[row, slot], first)

    maxima = _by_stretch(curve, len(thresholds), "k long, precision double", of_stretch, thresholds)
    peaks = maxima.groupBy(*group, "k").agg(F.max("precision").alias("p"))
    listed = peaks.groupBy(*group).agg(F.collect_list(F.struct("k", "p")).alias("peaks"))  # at most points + 1

    def best_from(i: Column) -> Column:
        hit = F.transform(F.filter("peaks", lambda s: s["k"] > i), lambda s: s["p"])
        return F.coalesce(F.array_max(hit), F.lit(0.0))

    total = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(points - 1)), best_from), F.lit(0.0), lambda a, x: a + x
    )
    ap = listed.select(*group, (total / points).alias("ap"))
    grid = npos.withColumn("threshold", F.explode(F.lit([float(t) for t in thresholds])))
    return grid.join(ap, group, "left").select(*group, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def all_point_ap(curve: DataFrame, npos: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """`category_id`, `area`, `threshold`, `ap`: area under the precision envelope.

    Each hit adds 1/npos times the best precision from there on: a running maximum from the low-score end,
    inside a stretch and over the best of each stretch after it.
    """
    group = ["category_id", "area", "threshold"]
    nt = len(thresholds)

    def falling(hit, tps, seen):
        at_hits = np.where(hit, tps / np.maximum(seen, 1), -np.inf)
        return np.maximum.accumulate(at_hits[::-1], axis=0)[::-1]

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                hit, tps, seen, _ = _slots(b, i, nt)
                yield pa.RecordBatch.from_arrays(
                    [*[b[c].slice(i, 1) for c in ("category_id", "__range", "__no")], _lists(falling(hit, tps, seen)[:1])],
                    names=["category_id", "__range", "__no", "__top"])

    def of_stretch(b, i, hit, tps, seen, npos):
        env = np.maximum(falling(hit, tps, seen), _numbers(b, "__after", i))
        slot = np.flatnonzero(hit.any(axis=0))
        return slot, np.where(hit, env, 0.0).sum(axis=0)[slot]

    keys = ["category_id", "__range", "__no"]
    kind = T.StructType([*[curve.schema[c] for c in keys], T.StructField("__top", T.ArrayType(T.DoubleType()))])
    top = curve.select(*keys, "hits", "counted", "hits_before", "counted_before", "npos").mapInArrow(tops, kind)
    by = Window.partitionBy("category_id").orderBy(F.desc("__range"), F.desc("__no")).rowsBetween(Window.unboundedPreceding, -1)
    after = written(top, "tops")
    slots = after.select(F.max(F.size("__top"))).first()[0] or 0
    least = F.lit(float("-inf"))
    after = after.select("__range", "__no", F.array(
        *[F.coalesce(F.max(F.get("__top", F.lit(k))).over(by), least) for k in range(slots)]).cast("array<double>").alias("__after"))
    sums = _by_stretch(curve.join(after, ["__range", "__no"]), nt, "env double", of_stretch, thresholds, ["__after"])
    total = sums.groupBy(*group).agg(F.sum("env").alias("env"))
    grid = npos.withColumn("threshold", F.explode(F.lit([float(t) for t in thresholds])))
    ap = F.col("env") / F.col("npos")
    return grid.join(total, group, "left").select(*group, F.coalesce(ap, F.lit(0.0)).alias("ap"))


def coco_ap(dets: DataFrame, gt: DataFrame, areas: Sequence[str] = ("all", "small", "medium", "large"),
            pairs: DataFrame | None = None, max_dets: int = 100) -> DataFrame:
    """`category_id`, `area`, `threshold`, `ap` in 0..1; see `coco_summary`."""
    dets, gt = materialize(dets), materialize(gt)  # both are read several times
    names = [r[0] for r in AREA_RANGES if r[0] in areas]
    size = MAX_SLOTS // len(IOU_THRESHOLDS)
    out = None
    for part in (names[i:i + size] for i in range(0, len(names), size)):
        npos = ground_truth_counts(gt, part)
        matches = materialize(coco_matches(dets, gt, IOU_THRESHOLDS, part, max_dets, pairs))
        ap = interpolated_ap(precision_recall(matches, npos, IOU_THRESHOLDS, part), npos, IOU_THRESHOLDS)
        out = ap if out is None else out.unionByName(ap)
    return out


def coco_summary(ap: DataFrame) -> DataFrame:
    """One row: AP, AP50, AP75, APs, APm, APl in percent; NULL when nothing counts."""
    def mean(cond: Column) -> Column:
        return F.avg(F.when(cond, F.col("ap"))) * 100.0

    everything = F.col("area") == "all"
    return ap.agg(
        mean(everything).alias("ap"), mean(everything & (F.col("threshold") == 0.5)).alias("ap50"),
        mean(everything & (F.col("threshold") == 0.75)).alias("ap75"), mean(F.col("area") == "small").alias("aps"),
        mean(F.col("area") == "medium").alias("apm"), mean(F.col("area") == "large").alias("apl"),
    )


def per_category_ap(ap: DataFrame) -> DataFrame:
    return ap.filter("area = 'all'").groupBy("category_id").agg((F.avg("ap") * 100.0).alias("ap"))


def pascal_map(dets: DataFrame, gt: DataFrame, iou: float = 0.5) -> DataFrame:
    """`category_id`, `ap` in 0..1 at one threshold, all-point area; the mean over rows is the mAP."""
    dets, gt = materialize(dets), materialize(gt)  # both are read several times
    npos = ground_truth_counts(gt, ["all"])
    matches = materialize(coco_matches(dets, gt, [iou], ["all"], max_dets=None))
    return all_point_ap(precision_recall(matches, npos, [iou]), npos, [iou]).select("category_id", "ap")


def hierarchy_closure(parents: DataFrame) -> DataFrame:
    """`category_id`, `ancestor` for every class and itself, from (category_id, parent_id).

    A join for each level of the hierarchy; a class may have several parents. A cycle is an error.
    """
    edges = written(parents.filter("parent_id IS NOT NULL").select("category_id", "parent_id").distinct(), "parents")
    names = edges.select("category_id").unionByName(edges.select(F.col("parent_id").alias("category_id"))).distinct()
    closure, level, depth = names.withColumn("ancestor", F.col("category_id")), edges.withColumnRenamed("parent_id", "ancestor"), 0
    most = names.count()
    while not level.isEmpty():
        depth += 1
        if depth >= max(most, 1) or not level.filter("category_id = ancestor").isEmpty():
            raise ValueError("the class hierarchy has a cycle")
        closure = closure.unionByName(level)
        up = edges.select(F.col("category_id").alias("ancestor"), "parent_id")
        level = written(level.join(up, "ancestor").select("category_id", F.col("parent_id").alias("ancestor")).distinct(), "ancestors")
    return closure.distinct()


def with_ancestors(boxes: DataFrame, closure: DataFrame) -> DataFrame:
    """Every box once for its class and once for each ancestor of it; a class outside the hierarchy stays as it is."""
    up = closure.groupBy("category_id").agg(F.collect_set("ancestor").alias("__up"))  # as many as a class has ancestors
    listed = F.coalesce("__up", F.array("category_id"))
    return boxes.join(up, "category_id", "left").withColumn("category_id", F.explode(listed)).drop("__up")


def _ancestor_matches(dets: DataFrame, gt: DataFrame, closure: DataFrame | None, iou: float, groups_count: bool) -> DataFrame:
    """The rows of `coco_matches`, each box repeated for the ancestors of its class, the best detection of a group a hit."""
    by = ["image_id", "category_id"]
    if closure is not None:
        dets, gt = with_ancestors(dets, closure), with_ancestors(gt, closure)
    dets, gt = written(dets, "detections"), written(gt, "truth")
    matches = written(coco_matches(dets, gt, [iou], ["all"], max_dets=None), "matches")
    if not groups_count:
        return matches
    groups = gt.filter("iscrowd = 1")
    # Detections that a group took: neither hit nor counted.
    idle = matches.filter("hits = 0 AND counted = 0").select(*by, "id", "score").join(dets.drop("score"), [*by, "id"])
    inside = overlapping_pairs(idle.select(*by, "id", "score", *BOX), groups.select(*by, "id", "iscrowd", *BOX), by).filter(F.col("iou") >= iou)
    own = inside.groupBy(*by, F.col("a.id").alias("id"), F.col("a.score").alias("score")).agg(
        F.min(F.struct((-F.col("iou")).alias("o"), F.col("b.id").alias("group"))).alias("best"))
    first = own.groupBy(*by, F.col("best.group").alias("group")).agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("d"))
    found = first.select(*by, F.col("d.id").alias("id"), F.lit(1).cast("long").alias("__hit"))
    raised = matches.join(found, [*by, "id"], "left")
    raised = raised.withColumns({c: F.greatest(F.col(c), F.coalesce("__hit", F.lit(0).cast("long"))) for c in ("hits", "counted")}).drop("__hit")
    return written(raised, "raised")


# Boxes of an image on one side that a task holds to match the image in one pass, and rows of a class hierarchy
# that every task holds for it.
IMAGE_BOXES = 512
MAX_LINEAGE = 100_000
# Boxes whose images are put together at a time, so that not all of them lie on disk twice; the input is read once
# for each part, so there are at most IMAGE_PARTS.
PART_ROWS, IMAGE_PARTS = 5_000_000, 8


def _listed_ancestors(closure: DataFrame | None) -> dict | None:
    """Ancestors of each class; None for a hierarchy too large to be held, or too deep for the bits of a long."""
    if closure is None:
        return {}
    if closure.count() > MAX_LINEAGE:
        return None
    rows = closure.filter("category_id IS NOT NULL").groupBy("category_id").agg(F.sort_array(F.collect_set("ancestor")).alias("up")).collect()
    return {r[0]: r[1] for r in rows} if all(len(r[1]) <= MAX_SLOTS for r in rows) else None


def _plain_boxes(dets: DataFrame, gt: DataFrame) -> bool:
    """Whether the columns are of the types that the pass over images reads."""
    kinds = [(df.schema[c].dataType, k) for df in (dets, gt) for c, k in [("id", T.IntegralType), *[(c, T.DoubleType) for c in BOX]]]
    kinds.append((dets.schema["score"].dataType, (T.DoubleType, T.FloatType)))
    same = all(dets.schema[c].dataType == gt.schema[c].dataType for c in ("image_id", "category_id"))
    return same and all(isinstance(t, k) for t, k in kinds)


def _class_matches(dets: DataFrame, gt: DataFrame, closure: DataFrame | None, listed: dict, iou: float, groups_count: bool) -> DataFrame:
    """`image_id`, `category_id`, `id`, `score`, `counted`, `hits`, `kind`: a detection once, its bits by the ancestors of its class.

    Images of at most IMAGE_BOXES boxes on each side are read once by the task that holds them, without a table
    of overlaps or of boxes for ancestors, a part of the images at a time. Other images, and those whose ids are null or come twice, take
    `_ancestor_matches`, with a row for each category.
    """
    sides = [x.select("image_id", F.lit(a).alias("a"), F.lit(1 - a).alias("b")) for x, a in ((dets, 1), (gt, 0))]
    large = sides[0].unionByName(sides[1]).groupBy("image_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    large = written(large.filter(F.greatest("a", "b") > IMAGE_BOXES).select("image_id"), "large-images")
    area = F.col("area") if "area" in dets.columns else B.area(*[F.col(c) for c in BOX])

    def flag(test: Column, bit: int) -> Column:
        return F.when(test, bit).otherwise(0)

    in_range = lambda x: x.between(*AREA_RANGES[0][1:])
    crowd = F.coalesce("iscrowd", F.lit(0)) == 1
    kind = flag(crowd, IP.CROWD) + flag(~crowd & in_range(F.col("area")), IP.SERVES) + flag(~crowd & F.col("area").isNull(), IP.UNSIZED) + IP.TRUTH
    held = ["image_id", "category_id", F.col("id").cast("long").alias("id"), *BOX]
    boxes = dets.select(*held, "score", flag(in_range(area), IP.IN_RANGE).alias("kind")).unionByName(
        gt.select(*held, F.lit(None).cast(dets.schema["score"].dataType).alias("score"), kind.alias("kind")))
    if not large.isEmpty():
        boxes = _without(boxes, large, ["image_id"])
    columns = ["image_id", "category_id", "id", "score"]
    schema = T.StructType([*[T.StructField(c, boxes.schema[c].dataType) for c in columns], T.StructField("counted", T.LongType()),
                           T.StructField("hits", T.LongType()), T.StructField("kind", T.IntegerType())])
    run = IP.image_matches(listed, iou, groups_count, schema.names)
    parts = max(1, min(IMAGE_PARTS, -(-(dets.count() + gt.count()) // PART_ROWS)))
    part = F.pmod(F.xxhash64("image_id"), F.lit(parts))
    some = [boxes.filter(part == i) if parts > 1 else boxes for i in range(parts)]
    tables = [written(x.repartition("image_id").sortWithinPartitions("image_id").mapInArrow(run, schema), "matches") for x in some]
    table = functools.reduce(DataFrame.unionByName, tables)
    rest = written(large.unionByName(table.filter(F.col("kind") == IP.LEFT).select("image_id")).distinct(), "images-left")
    table = table.filter(F.col("kind") != IP.LEFT)
    if rest.isEmpty():
        return table
    other = _ancestor_matches(_within(dets, rest, ["image_id"]), _within(gt, rest, ["image_id"]), closure, iou, groups_count)
    return table.unionByName(other.withColumns({"id": F.col("id").cast("long"), "kind": F.lit(IP.OF_CATEGORY)}))


def open_images_ap(dets: DataFrame, gt: DataFrame, parents: DataFrame | None = None, iou: float = 0.5, groups_count: bool = True) -> DataFrame:
    """`category_id`, `ap` in 0..1, all-point area; the mean over rows is the mAP.

    gt: image_id, category_id, id, box, area, is_group. With `parents` (category_id, parent_id) boxes count for
    the ancestors of their class too. A box of a group takes any number of detections that lie in it by `iou` of
    their own area and are matched to no other box; with `groups_count` the best of them is one hit and the
    box one to be found, else they are all left out. Equal overlaps go to the smaller id of the group's box.
    `dets` and `gt` are read several times.
    """
    closure = None if parents is None else written(hierarchy_closure(parents), "closure")
    gt = gt.withColumn("iscrowd", F.col("is_group").cast("int")).drop("is_group")
    npos = ground_truth_counts(gt, ["all"])
    if groups_count:
        of_groups = gt.filter("iscrowd = 1").filter(F.col("area").between(*AREA_RANGES[0][1:])).groupBy(
            "category_id", F.lit("all").alias("area")).agg(F.count(F.lit(1)).alias("npos"))
        npos = npos.unionByName(of_groups)
    npos = npos if closure is None else with_ancestors(npos, closure)
    npos = written(npos.groupBy("category_id", "area").agg(F.sum("npos").alias("npos")), "positives")
    listed = _listed_ancestors(closure)
    if listed is not None and _plain_boxes(dets, gt):
        curve = class_curve(_class_matches(dets, gt, closure, listed, iou, groups_count), npos, listed)
    else:
        curve = precision_recall(_ancestor_matches(dets, gt, closure, iou, groups_count), npos, [iou])
    return all_point_ap(curve, npos, [iou]).select("category_id", "ap")


# The spread of each of the 17 body keypoints, and the detections of an image that count.
OKS_SIGMAS = [
    0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089,
]
KEYPOINT_MAX_DETS = 20


def pixel_keypoints(keypoints: Column) -> Column:
    """Predicted keypoints (x, y, score, ...) moved by half a pixel, as annotations count pixels."""
    return F.transform(keypoints, lambda v, i: F.when(i % 3 == 2, v).otherwise(v - 0.5))


def keypoint_pairs(dets: DataFrame, gt: DataFrame, sigmas: Sequence[float], least: float) -> DataFrame:
    """image_id, category_id, a (id, score), b (id, area, iscrowd), iou: pairs whose similarity is `least` or more.

    dets: image_id, category_id, id, score, keypoints; gt: image_id, category_id, id, keypoints, area, iscrowd
    and a box. A mean of `least` needs one keypoint with as much, which bounds its distance: the keypoint of
    the detection lies in a square around that of the ground truth, whose size follows from its area and
    spread. So candidates come from the spatial join, keypoint by keypoint, and not from all pairs. Ground truth
    without a labelled keypoint is compared by the distance from its box made three times as large.
    """
    by = ["image_id", "category_id"]
    reach = F.lit([2 * s * math.sqrt(-2 * math.log(least)) for s in sigmas])
    ks = F.sequence(F.lit(0), F.lit(len(sigmas) - 1))
    at = lambda k, d: F.get("keypoints", F.col("k") * 3 + d).cast("double")
    held = [F.col(c) for c in ("image_id", "category_id", "id")]
    labelled = F.exists(F.transform("keypoints", lambda v, i: (i % 3 == 2) & (v > 0)), lambda x: x)
    points = dets.select(*held, F.explode(ks).alias("k"), "keypoints").select(
        *by, "k", "id", (at("k", 0) - TINY).alias("x0"), (at("k", 1) - TINY).alias("y0"), (at("k", 0) + TINY).alias("x1"),
        (at("k", 1) + TINY).alias("y1"))
    truth = gt.withColumn("free", ~labelled)
    r = F.get(reach, F.col("k")) * F.sqrt("area") + 2 * TINY
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")

    def side(lo: Column, hi: Column, d: int) -> tuple[Column, Column]:
        """Where the keypoint may lie: around its own place, or around the enlarged box."""
        return F.when(F.col("free"), lo).otherwise(at("k", d)) - r, F.when(F.col("free"), hi).otherwise(at("k", d)) + r

    (x0, x1) = side(F.col("x0") - wide, F.col("x1") + wide, 0)
    (y0, y1) = side(F.col("y0") - high, F.col("y1") + high, 1)
    squares = truth.withColumn("k", F.explode(ks)).filter(F.col("free") | (at("k", 2) > 0)).select(
        *by, "k", "id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    near = overlapping_pairs(points, squares, [*by, "k"]).select(*by, F.col("a.id").alias("det"), F.col("b.id").alias("gt")).distinct()
    a = dets.select(*by, F.col("id").alias("det"), "score", F.col("keypoints").alias("p"))
    b = truth.select(*by, F.col("id").alias("gt"), F.col("keypoints").alias("g"), "area", "iscrowd", "free", *BOX)
    both = near.join(a, [*by, "det"]).join(b, [*by, "gt"])
    area = F.col("area") + F.lit(2.0**-52)  # a little more than nothing
    away = B.box_keypoint_similarity(F.col("p"), *[F.col(c) for c in BOX], list(sigmas), area)
    sim = F.when(F.col("free"), away).otherwise(B.oks(F.col("p"), F.col("g"), list(sigmas), area))
    # Ground truth without keypoints is no target: an area outside every range.
    area = F.when(F.col("free"), F.lit(-1.0)).otherwise(F.col("area"))
    return both.withColumn("iou", sim).filter(F.col("iou") >= least).select(
        *by, F.struct(F.col("det").alias("id"), "score").alias("a"),
        F.struct(F.col("gt").alias("id"), area.alias("area"), "iscrowd").alias("b"), "iou")


# Half the side of the square that stands for a point.
TINY = 1e-6


def keypoint_ap(dets: DataFrame, gt: DataFrame, sigmas: Sequence[float] = OKS_SIGMAS) -> DataFrame:
    """One row: AP, AP50, AP75, APm, APl of keypoints in percent.

    The keypoints of detections are pixel indices (`pixel_keypoints`). Keypoints that are not as many as
    `sigmas` raise an error. Of an image and category the best 20 detections count, and their area is that
    of the box around their keypoints; ground truth without a labelled keypoint is neither found nor missed.
    """
    dets, gt = written(dets, "detections"), written(gt, "truth")
    for name, df in (("detection", dets), ("ground truth", gt)):
        low, high = df.agg(F.min(F.size("keypoints")), F.max(F.size("keypoints"))).first()
        if low is not None and (low, high) != (3 * len(sigmas), 3 * len(sigmas)):
            raise ValueError(f"{len(sigmas)} sigmas, but a {name} has {(low if low != 3 * len(sigmas) else high) / 3:g} keypoints")
    along = lambda d: F.filter("keypoints", lambda v, i: i % 3 == d)
    area = (F.array_max(along(0)) - F.array_min(along(0))) * (F.array_max(along(1)) - F.array_min(along(1)))
    sized = dets.withColumn("area", area.cast("double"))
    labelled = F.exists(F.transform("keypoints", lambda v, i: (i % 3 == 2) & (v > 0)), lambda x: x)
    targets = gt.withColumn("area", F.when(labelled, F.col("area")).otherwise(F.lit(-1.0)))
    top = written(top_n_per_group(sized, ["image_id", "category_id"], ["-score", "id"], KEYPOINT_MAX_DETS), "best-detections")
    pairs = written(keypoint_pairs(top, gt, sigmas, IOU_THRESHOLDS[0]), "keypoint-pairs")
    ap = coco_ap(top, targets, ("all", "medium", "large"), pairs, KEYPOINT_MAX_DETS)
    return coco_summary(ap).select("ap", "ap50", "ap75", "apm", "apl")


def mask_ap(dets: DataFrame, gt: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: AP, AP50, AP75, APs, APm, APl of masks in percent.

    `dets` and `gt` have `area`, that of the mask and not of the box; `pairs` (image_id, category_id, a, b,
    iou) are the overlaps of masks.
    """
    return coco_summary(coco_ap(dets, gt, pairs=pairs))


def coco_result_rows(dets: DataFrame) -> DataFrame:
    """Detections as result rows: image_id, category_id, bbox [x, y, w, h], score."""
    x, y, w, h = B.xyxy_to_xywh(*[F.col(c) for c in BOX])
    return dets.select("image_id", "category_id", F.array(x, y, w, h).alias("bbox"), "score")
