"""Mean pooling, class prototypes, nearest-prototype classification, retrieval, batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from datasheaf.functions.arrays import as_double, let, squared_distance, total
from datasheaf.session import work_folder
from datasheaf.sources.jsonfile import located

# Values (vectors x dimensions) a task may hold as one array: 2M doubles, 16 MB.
INLINE_VALUES = 2_000_000


def vector_size(df: DataFrame, vec: str) -> int:
    """Length that all vectors share; 0 for an empty table. Vectors of different lengths are an error."""
    least, most = df.select(F.min(F.size(vec)), F.max(F.size(vec))).first()
    if least != most:
        raise ValueError(f"{vec} holds vectors of {least} to {most} values")
    return most or 0


def mean_pool(vec: Column | str, tokens: int, dim: int, mask: Column | None = None) -> Column:
    """Mean over the token vectors of a flat (tokens x dim) array, padding included.

    With a mask (array of 0/1 per token) only the marked positions count.
    """
    v = as_double(vec)

    def at(t: Column, d: Column) -> Column:
        return F.get(v, (t * dim + d).cast("int"))

    positions = F.sequence(F.lit(0), F.lit(tokens - 1))
    if mask is not None:
        positions = F.filter(positions, lambda t: F.get(mask, t) == 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda d: total(F.transform(positions, lambda t: at(t, d))) / F.size(positions),
    )


def class_centroids(df: DataFrame, label: str, vec: str, dim: int | None = None) -> DataFrame:
    """`label`, `proto`: the mean vector of every class.

    One average per dimension, so a class of any size is combined before the shuffle and no row is
    exploded.
    """
    n = dim or vector_size(df, vec)
    sums = df.groupBy(label).agg(*[F.avg(F.get(vec, F.lit(i))).alias(f"d{i}") for i in range(n)])
    return sums.select(label, F.array(*[f"d{i}" for i in range(n)]).alias("proto"))


def _partials(df: DataFrame, vec: str, protos: Column, own: str | None) -> DataFrame:
    """Best prototype and the pieces of a log-softmax over one list of prototypes."""
    dists = let(as_double(vec), lambda v: F.transform(
        protos, lambda p: F.struct(squared_distance(v, p["proto"]).alias("d"), p["label"].alias("label"))
    ))
    out = df.withColumn("__d", dists).withColumn("__best", F.array_min("__d"))
    mass = let(F.col("__best.d"), lambda b: total(F.transform("__d", lambda s: F.exp(b - s["d"]))))
    out = out.withColumn("__mass", mass)
    if own is not None:
        hit = F.filter("__d", lambda s: s["label"] == F.col(own))
        out = out.withColumn("__own", F.get(hit, F.lit(0))["d"])
    return out.drop("__d")


def _in_blocks(named: DataFrame, inline_values: int) -> tuple[int, Callable[[int], tuple[list, np.ndarray]]]:
    """(name, vector) rows written in blocks of at most about `inline_values` values; a task reads a block at a time.

    Returns the number of blocks and a function that gives the sorted names and the vectors of one.
    """
    name, vec = named.columns
    size = named.select(F.count(F.lit(1)), F.max(F.size(vec))).first()
    blocks = max(1, -(-size[0] * (size[1] or 0) // inline_values))
    folder = work_folder(named.sparkSession, "blocks")
    number = F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int").alias("block")
    named.select(name, vec, number).repartition(blocks, "block").sortWithinPartitions("block", name).write.partitionBy("block").parquet(folder)

    def read(block: int) -> tuple[list, np.ndarray]:
        fs, path = located(f"{folder}/block={block}")
        if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            return [], np.zeros((0, 0))
        t = ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=[name, vec]).sort_by(name)
        return t[name].to_pylist(), np.array(t[vec].to_pylist(), float)

    return blocks, read


def _scored_in_blocks(queries: DataFrame, vec: str, named: DataFrame, own: str | None, inline_values: int) -> DataFrame:
    """`__best` (d, label), `__mass` and `__own` as `_partials` gives them, over prototypes of any number."""
    blocks, read = _in_blocks(named, inline_values)
    kind = named.schema["label"].dataType
    framed = queries.select(F.struct(*[F.col(f"`{c}`") for c in queries.columns]).alias("row"), as_double(vec).alias("v"),
                            (F.col(own).cast(kind) if own is not None else F.lit(None).cast(kind)).alias("y"))
    best = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("label", kind)])
    doubles = [T.StructField(c, T.DoubleType()) for c in ("__mass", "__own")]
    schema = T.StructType([framed.schema["row"], T.StructField("__best", best), *doubles])
    kinds = to_arrow_schema(schema).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x, y = np.array(b["v"].to_pylist(), float), b["y"].to_pylist()
                least, names = np.full(len(x), np.inf), [None] * len(x)
                mass, mine = np.zeros(len(x)), [None] * len(x)
                for block in range(blocks):
                    labels, protos = read(block)
                    places = {c: j for j, c in enumerate(labels)}
                    for i in range(len(x)) if labels else ():
                        d = ((protos - x[i]) ** 2).sum(1)
                        j = int(d.argmin())
                        if names[i] is None or (d[j], labels[j]) < (least[i], names[i]):
                            mass[i] = mass[i] * np.exp(d[j] - least[i]) if names[i] is not None else 0.0
                            least[i], names[i] = d[j], labels[j]
                        mass[i] += np.exp(least[i] - d).sum()
                        if y[i] in places:
                            mine[i] = float(d[places[y[i]]])
                pairs = [{"d": d, "label": c} for d, c in zip(least.tolist(), names, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b["row"], pa.array(pairs, kinds[1]), pa.array(mass), pa.array(mine, pa.float64())], schema.names)

    return framed.mapInArrow(run, schema).select("row.*", "__best", "__mass", *(["__own"] if own is not None else []))


def prototype_classify(
    queries: DataFrame, id_col: str, vec: str, protos: DataFrame, label: str | None = None,
    inline_values: int = INLINE_VALUES,
) -> DataFrame:
    """Adds `pred`, `distance`, `log_prob` of the nearest prototype (smaller label on ties), and
    `loss`, the negative log-softmax at the true label when `label` is given.

    `protos` (label, proto) is counted first. A small table is read once and held by each task; of a
    larger one a task reads block after block for the queries it has, and keeps the best and the sum so far.
    """
    named = protos.select(F.col(protos.columns[0]).alias("label"), "proto")
    size = named.select(F.count(F.lit(1)), F.max(F.size("proto"))).first()
    values = size[0] * (size[1] or 0)
    listed = F.array_sort(F.collect_list(F.struct("label", "proto")))
    if values <= inline_values:
        held = queries.withColumn("__p", named.agg(listed).scalar())
        scored = _partials(held, vec, F.col("__p"), label).drop("__p")
    else:
        scored = _scored_in_blocks(queries, vec, named.withColumn("proto", as_double("proto")), label, inline_values)
    out = (
        scored.withColumn("pred", F.col("__best.label"))
        .withColumn("distance", F.col("__best.d"))
        .withColumn("log_prob", -F.ln("__mass"))
    )
    if label is not None:
        out = out.withColumn("loss", F.col("__own") - F.col("__best.d") + F.ln("__mass")).drop("__own")
    return out.drop("__best", "__mass")


def _nearest_of(x: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of `q` the rows of `x` that may be among its k nearest, ties included, and their squared distances.

    Products from the middle of `x` choose them, exact differences measure them.
    """
    middle = x.mean(0)
    cx = x - middle
    own = (cx * cx).sum(1)
    for at in range(0, len(q), 256):
        cq = q[at:at + 256] - middle
        scale = (cq * cq).sum(1)[:, None] + own[None]
        rough = scale - 2 * (cq @ cx.T)
        few = min(k, len(x))
        limit = np.partition(rough, few - 1, axis=1)[:, few - 1:few]
        for i in range(len(cq)):
            near = np.flatnonzero(rough[i] <= limit[i] + 1e-9 * scale[i])
            yield at + i, near, ((x[near] - q[at + i]) ** 2).sum(1)


def knn_topk(
    queries: DataFrame, corpus: DataFrame, k: int, query_id: str, corpus_id: str, query_vec: str,
    vec: str, inline_values: int = INLINE_VALUES,
) -> DataFrame:
    """The k nearest corpus rows of each query (squared distance, id on ties): exact.

    The queries are written once, in blocks of at most `inline_values` values. A task reads the corpus rows it
    has in stretches, takes block after block for each and passes on the k best of a stretch for each query: no
    row for a pair of query and corpus row, no copy of the corpus. Rows without a vector are no neighbours.
    """
    named = queries.select(F.col(query_id).alias("query"), as_double(query_vec).alias("qv")).filter("qv IS NOT NULL")
    blocks, read = _in_blocks(named, inline_values)
    rows = corpus.select(F.col(corpus_id).alias("id"), as_double(vec).alias("v")).filter("v IS NOT NULL")
    schema = T.StructType([
        T.StructField("query", named.schema["query"].dataType), T.StructField(corpus_id, rows.schema["id"].dataType),
        T.StructField("distance", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        values = 0
        kept = read(0) if blocks == 1 else None

        def ranked() -> Iterator[pa.RecordBatch]:
            ids = [i for b in held for i in b["id"].to_pylist()]
            x = np.array([v for b in held for v in b["v"].to_pylist()], float)
            for block in range(blocks):
                names, q = kept or read(block)
                out: list[tuple] = []
                for i, near, dist in _nearest_of(x, q, k) if len(names) else ():
                    best = sorted(zip(dist.tolist(), [ids[j] for j in near], strict=True))[:k]
                    out.extend((names[i], j, d) for d, j in best)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

        for b in batches:
            if b.num_rows:
                held.append(b)
                values += len(b["v"].flatten())
            if values > inline_values:
                yield from ranked()
                held, values = [], 0
        if held:
            yield from ranked()

    found = rows.mapInArrow(run, schema)
    w = Window.partitionBy("query").orderBy("distance", corpus_id)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def batch_score(
    df: DataFrame, setup: Callable[[], object],
    process: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str,
) -> DataFrame:
    """Load a scorer once per task and call it on every Arrow batch of the task's rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = setup()
        for b in batches:
            yield process(scorer, b)

    return df.mapInPandas(run, schema)
