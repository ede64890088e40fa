"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a balanced k-means over a bounded draw of vectors (`fit_rows`); there are as many as
the number of vectors asks for, up to a share of the draw. Every vector is indexed: it goes to its nearest
list and, near a boundary, to further lists. A graph over the centroids, small enough for every task, finds
the lists of a vector. How much farther than the nearest centroid the lists of a query's neighbours lie depends
on the vectors: it is measured on the draw, by brute force, for each list. A query's beam over the graph is
widened until its farthest centroid is beyond that, and beyond `reach` times the nearest one's distance; all
lists nearer are read. Lists are cut into parts of bounded size, and so are the queries that meet in a list.

Equal vectors are indexed once, with the few smallest ids that a result can hold.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datasheaf.llm.common import written

FIT_ROWS = 20_000
LIST_ROWS, PART_ROWS, QUERY_ROWS = 128, 4096, 1024
REPLICAS, CLOSURE = 4, 1.25
REACH = 1.17
# About as many rows of the draw are searched by brute force; the share of their neighbours that a slack has to cover.
MEASURED_ROWS, COVERED = 3000, 0.98
# Centroids that a query's beam holds at first.
BEAM = 64
# Rows that a task routes at once.
ROUTED_ROWS = 16_384
# Queries whose nearest a task holds before it gives them away.
HELD_QUERIES = 20_000


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, of vectors moved to the middle of `b`: a common offset would drown the differences."""
    middle = b.mean(0) if len(b) else 0.0
    a, b = a - middle, b - middle
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 8, weight: float = 0.3, seed: int = 0) -> np.ndarray:
    """k-means in which a list's fill adds to the distance from it."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    fill = np.full(k, len(x) / k)
    for _ in range(rounds):
        near = np.empty(len(x), np.int64)
        for at in range(0, len(x), 2048):
            d = squared(x[at:at + 2048], c)
            near[at:at + 2048] = (d + weight * d.min(1).mean() * np.maximum(fill / (len(x) / k) - 1, 0)).argmin(1)
        fill = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[order], np.r_[0, np.cumsum(fill)[:-1]].clip(max=len(x) - 1), axis=0)
        c = np.where(fill[:, None] > 0, sums / np.maximum(fill, 1)[:, None], c)
    return c


class CentroidGraph:
    """Centroids linked to their nearest ones and to some at random; a beam walks it for many vectors at once."""

    def __init__(self, centroids: np.ndarray, links: int = 24, chance: int = 8):
        self.c = centroids
        k = len(centroids)
        rng = np.random.default_rng(1)
        near = np.empty((k, min(links, k)), np.int64)
        for at in range(0, k, 1024):
            d = squared(centroids[at:at + 1024], centroids)
            near[at:at + 1024] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, :near.shape[1]]
        self.links = np.hstack([near, rng.integers(0, k, (k, chance))])
        # Entries far apart from each other, so that a distant group of centroids has one.
        far, self.entries = np.full(k, np.inf), np.zeros(min(32, k), np.int64)
        for i in range(1, len(self.entries)):
            far = np.minimum(far, ((centroids - centroids[self.entries[i - 1]]) ** 2).sum(1))
            self.entries[i] = far.argmax()

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the centroids found for each row of q, nearest first; -1 and inf fill up."""
        m, k = len(q), len(self.c)
        beam = min(beam, k)
        rows = np.arange(m)[:, None]
        seen = np.zeros((m, k), bool)
        ids = np.full((m, beam), -1)
        dist = np.full((m, beam), np.inf)
        done = np.zeros((m, beam), bool)
        new = np.repeat(self.entries[None], m, 0)
        while True:
            d = ((self.c[new] - q[:, None]) ** 2).sum(2)
            d[seen[rows, new]] = np.inf
            # A node may be linked twice: only its first place counts.
            order = np.argsort(new, axis=1, kind="stable")
            twice = np.zeros_like(new, bool)
            np.put_along_axis(twice, order[:, 1:], np.diff(np.take_along_axis(new, order, 1), axis=1) == 0, 1)
            d[twice] = np.inf
            seen[rows, new] = True
            ids, dist, done = np.hstack([ids, new]), np.hstack([dist, d]), np.hstack([done, np.zeros_like(twice)])
            best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = (np.take_along_axis(a, best, 1) for a in (ids, dist, done))
            open_dist = np.where(done, np.inf, dist)
            # The nearest two open centroids of each row are expanded together.
            at = np.argsort(open_dist, axis=1, kind="stable")[:, :2]
            if not np.isfinite(np.take_along_axis(open_dist, at, 1)).any():
                return np.where(np.isfinite(dist), ids, -1), np.sqrt(dist)
            np.put_along_axis(done, at, True, 1)
            new = self.links[np.maximum(np.take_along_axis(ids, at, 1), 0)].reshape(m, -1)


def nearest_rows(q: np.ndarray, p: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row of q the rows of p that can be among its k nearest ones, ties included, by bounds on the rounding."""
    approx = squared(q, p)
    middle = p.mean(0)
    size = ((q - middle) ** 2).sum(1)[:, None] + ((p - middle) ** 2).sum(1)[None]
    error = (4 + q.shape[1]) * np.finfo(float).eps * size
    k = min(k, len(p))
    least = np.partition(approx + error, k - 1, axis=1)[:, k - 1]
    for at in approx - error <= least[:, None]:
        yield np.nonzero(at)[0]


def measured_slack(c: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """For each centroid of `c`: how much farther than it the lists of a neighbour may lie, by the draw `x`.

    Some rows of each list are compared with the whole draw. Neighbours in the draw are farther away than those
    in the table, so their lists are no nearer. The least slack is that of all lists, in proportion to the
    distance of their vectors.
    """
    if len(x) <= 1:
        return np.zeros(len(c))
    few = min(REPLICAS, len(c))
    to = np.empty((len(x), few), np.int64)
    dist = np.empty((len(x), few))
    for at in range(0, len(x), 1024):
        d = np.sqrt(squared(x[at:at + 1024], c))
        to[at:at + 1024] = near = np.argsort(d, axis=1, kind="stable")[:, :few]
        dist[at:at + 1024] = np.take_along_axis(d, near, 1)
    to = np.where(dist <= CLOSURE * dist[:, :1], to, to[:, :1])
    held = np.bincount(to[:, 0], minlength=len(c))
    scale = np.bincount(to[:, 0], dist[:, 0], len(c)) / np.maximum(held, 1)
    scale = np.maximum(scale, np.median(scale))
    # As many rows of every list.
    by_list = np.argsort(to[:, 0], kind="stable")
    nth = np.arange(len(x)) - np.repeat(np.cumsum(held) - held, held)
    asked = by_list[nth < max(5, MEASURED_ROWS // len(c))]
    beyond = np.empty((len(asked), min(k, len(x) - 1)))
    for at in range(0, len(asked), 256):
        rows = asked[at:at + 256]
        d = squared(x[rows], x)
        d[np.arange(len(rows)), rows] = np.inf
        lists = to[np.argpartition(d, beyond.shape[1] - 1, axis=1)[:, :beyond.shape[1]]]
        away = np.sqrt(squared(x[rows], c))
        found = np.take_along_axis(away, lists.reshape(len(rows), -1), 1).reshape(lists.shape).min(2)
        beyond[at:at + 256] = found - away.min(1)[:, None]
    own = to[asked, 0]
    usual = scale[own, None]
    slack = np.quantile(np.divide(beyond, usual, out=np.zeros_like(beyond), where=usual > 0), COVERED) * scale
    for rows in np.split(np.arange(len(asked)), np.nonzero(np.diff(own))[0] + 1):
        at, met = own[rows[0]], beyond[rows]
        slack[at] = max(slack[at], np.quantile(met, COVERED) if met.size >= 50 else met.max())
    return slack


def lists_within(
    graph: CentroidGraph, q: np.ndarray, reach: float, own: np.ndarray, need: int, slack: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `q` and their lists: those within `reach` of the nearest centroid or farther by no more than its `slack`,
    and nearer ones until they hold `need` vectors.

    The beam is doubled for the rows whose farthest centroid is not beyond that yet.
    """
    rows, to = [], []
    todo, beam = np.arange(len(q)), BEAM
    while len(todo):
        ids, dist = graph.search(q[todo], beam)
        held = np.cumsum(np.where(ids >= 0, own[ids], 0), axis=1)
        bound = reach * dist[:, :1]
        if slack is not None:
            bound = np.maximum(bound, dist[:, :1] + slack[ids[:, :1]])
        keep = (ids >= 0) & ((dist <= bound) | (np.c_[np.zeros(len(todo)), held[:, :-1]] < need))
        wide = ~keep[:, -1] if beam < len(graph.c) else np.ones(len(todo), bool)
        r, c = np.nonzero(keep & wide[:, None])
        rows.append(todo[r])
        to.append(ids[r, c])
        todo, beam = todo[~wide], 2 * beam
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(to or [np.zeros(0, int)])


class Nearest:
    """The k nearest ids of each query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.best = k, {}

    def __len__(self) -> int:
        return len(self.best)

    def farthest(self, query: int) -> float:
        """Nothing farther can be among the nearest."""
        best = self.best.get(query, ())
        return best[-1][0] if len(best) == self.k else np.inf

    def add(self, query: int, found: Iterable[tuple[float, int]]) -> None:
        new = sorted(found)
        if new:
            least: dict[int, float] = {}
            for d, o in heapq.merge(self.best.get(query, ()), new):
                if least.setdefault(o, d) == d and len(least) == self.k:
                    break
            self.best[query] = [(d, o) for o, d in least.items()]

    def taken(self) -> pa.RecordBatch:
        rows = [(q, o, d) for q, best in self.best.items() for d, o in best]
        self.best = {}
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])


def met_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, list[list[int]], np.ndarray]]:
    """Queries with their vectors, and points with theirs, of each (turn, list, part) that has both; rows come sorted by it."""
    here, asked, points = None, ([], []), ([], [])
    matrix = lambda v: np.frombuffer(b"".join(v), float).reshape(len(v), -1)
    for b in batches:
        columns = [b[c].to_pylist() for c in ("turn", "list", "part", "query_id", "ids", "v")]
        for *at, query, ids, v in zip(*columns, strict=True):
            if at != here:
                if asked[0] and points[0]:
                    yield asked[0], matrix(asked[1]), points[0], matrix(points[1])
                here, asked, points = at, ([], []), ([], [])
            side, name = (points, ids) if query is None else (asked, query)
            side[0].append(name)
            side[1].append(v)
    if asked[0] and points[0]:
        yield asked[0], matrix(asked[1]), points[0], matrix(points[1])


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """Distinct (vec_id, embedding) that take part: id and vector given, finite, not zero, of `dim` components.

    Without `dim`, the most frequent length (the smaller of two as frequent).
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter("vec_id is not null and size(embedding) > 0")
    rows = rows.filter(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    if dim is None:
        size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = size["d"] if size else 0
    return rows.filter(F.size("embedding") == dim).distinct()


def packed(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, reach: float = REACH, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found of each query.

    `queries` defaults to the vectors whose id is divisible by 100. A query's own id is no candidate.
    Ties go to the smaller id. With fewer than k candidates all are returned. An id with several vectors is
    as near as the nearest of them. Rows without a usable vector take no part; empty tables give no rows.
    """
    rows = usable(vectors)
    queries = rows.filter("vec_id % 100 = 0") if queries is None else usable(queries)
    smallest = Window.partitionBy("embedding").orderBy("vec_id")
    points = rows.withColumn("nth", F.row_number().over(smallest)).filter(F.col("nth") <= k + 1)
    points = points.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = written(points, "points")

    total = points.count()
    drawn = points.orderBy(F.md5(points["ids"][0].cast("string")), points["ids"][0]).limit(fit_rows).select("embedding").toArrow()
    if not drawn.num_rows:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    x = packed(drawn["embedding"].combine_chunks())
    lists = max(1, min(-(-total // LIST_ROWS), max(1, len(x) // 8)))
    # At most fit_rows / 8 centroids: the graph has a bounded size and goes to every task with the function.
    graph = CentroidGraph(balanced_centroids(x, lists))
    slack = measured_slack(graph.c, x, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                v = packed(s["embedding"])
                ids, dist = graph.search(v, 16)
                keep = (ids[:, :REPLICAS] >= 0) & (dist[:, :REPLICAS] <= CLOSURE * dist[:, :1])
                r, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[r, c]), pa.array(c == 0), s["ids"].take(pa.array(r)), pa.array([v[i].tobytes() for i in r], pa.binary())],
                    ["list", "own", "ids", "v"])

    postings = written(points.select("embedding", "ids").mapInArrow(assign, "list long, own boolean, ids array<long>, v binary"), "postings")
    sizes = postings.groupBy("list").agg(F.count("*").alias("rows"), F.sum(F.col("own").cast("long")).alias("own")).collect()
    own = np.zeros(lists, np.int64)
    for r in sizes:
        own[r["list"]] = r["own"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                v = packed(s["embedding"])
                r, to = lists_within(graph, v, reach, own, k + 1, slack)
                for i in range(0, len(r), ROUTED_ROWS):
                    some = r[i:i + ROUTED_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to[i:i + ROUTED_ROWS]), s["vec_id"].take(pa.array(some)), pa.array([v[j].tobytes() for j in some], pa.binary())],
                        ["list", "query_id", "q"])

    asked = written(queries.mapInArrow(route, "list long, query_id long, q binary"), "asked")
    spans = postings.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts")).join(
        asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("turns")), "list")
    # One row per list, no more than there are centroids.
    spans = F.broadcast(spans)
    deal = lambda column, n: F.pmod(F.xxhash64(column), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    left = asked.join(spans, "list").withColumn("turn", deal("query_id", F.col("turns"))).withColumn("part", every(F.col("parts")))
    right = postings.join(spans, "list").withColumn("part", deal("v", F.col("parts"))).withColumn("turn", every(F.col("turns")))
    keys = ["list", "part", "turn"]

    # A task holds the nearest of each query over all the lists that it reads, so a query gives no more than k rows
    # a task, however many lists it asks. Turns come first: a task goes on with the same queries from list to list.
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Nearest(k)
        for q, qv, ids, pv in met_groups(batches):
            least = np.array([i[0] for i in ids])
            for at in range(0, len(q), 256):
                some = qv[at:at + 256]
                for me, v, c in zip(q[at:at + 256], some, nearest_rows(some, pv, k + 1), strict=True):
                    d = np.sqrt(((pv[c] - v) ** 2).sum(1))
                    best = np.lexsort((least[c], d))[:k + 1]
                    held.add(me, ((d[i], o) for i in best if d[i] <= held.farthest(me) for o in ids[c[i]] if o != me))
            if len(held) > HELD_QUERIES:
                yield held.taken()
        yield held.taken()

    met = left.select(*keys, "query_id", F.lit(None).cast("array<long>").alias("ids"), F.col("q").alias("v")).unionByName(
        right.select(*keys, F.lit(None).cast("long").alias("query_id"), "ids", "v"))
    met = met.repartition(*keys).sortWithinPartitions("turn", "list", "part")
    best = met.mapInArrow(meet, "query_id long, vec_id long, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
