"""Dense positions and running aggregates over a total order, without a single-task window.

The rows are put in order once: ranges of the group and order columns (`repartitionByRange`), a sort in
each range, and a table in the shared folder in which each row has its place, the number of its range and
its row in it. One aggregate per range gives what the ranges before it contribute; these offsets, a row
for each range, are joined by the range's number. Because ranges are cut at whole keys (group columns,
then order columns), a group that holds a third of all rows is spread over many ranges like any other
stretch of the order.

Plain positions are offset plus row and need no window; running sums over the whole order are added up
as the table is written; other running aggregates take a window inside each range. The input is read twice,
by Spark's sample of the keys and for the table, and never again: what follows reads the columns it needs
from the table. There are as many ranges as the session has shuffle partitions, small ones merged, or
ranges of ROWS_PER_RANGE rows where that is set.

Groups are counted first: where none has more than ROWS_PER_GROUP rows, a window over the groups does the
same without a table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasheaf.session import cleaned, written

ROWS_PER_RANGE: int | None = None
ROWS_PER_GROUP = 1_000_000
_RANGE, _ROW = "__ds_range", "__ds_row"
# Spark puts the partition above the lowest 33 bits of its increasing ids.
_ROW_BITS = 33


def _parse(order_by: str | Sequence[str]) -> list[tuple[str, bool]]:
    """`"-name"` sorts descending."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return [(k[1:], True) if k.startswith("-") else (k, False) for k in keys]


def _sort_cols(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(k).desc() if d else F.col(k).asc() for k, d in keys]


def _added_up(columns: Sequence[str]):
    """Sums from the first row of a partition on, in place of the numbers themselves; null counts as 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = dict.fromkeys(columns, 0)
        for b in batches:
            for c in columns if b.num_rows else ():
                sums = np.cumsum(b[c].fill_null(0).to_numpy(zero_copy_only=False)) + ahead[c]
                ahead[c] = sums[-1]
                b = b.set_column(b.schema.get_field_index(c), c, pa.array(sums, b[c].type))
            yield b
    return run


def placed(
    df: DataFrame, keys: list[tuple[str, bool]], rows_per_range: int | None = None, sums: Sequence[str] = (),
    counted: dict[str, Column] | None = None, kept: Sequence[Column | str] = ("*",), compression: str | None = None,
) -> DataFrame:
    """`df` as a table in the order of `keys`, with the number of each row's range and its row in it.

    The columns `sums` hold their running sum inside the range. `counted` are columns worked out once the rows
    are in order, `kept` what the table holds of them, worked out as it is written.
    """
    cols = _sort_cols(keys)
    size = rows_per_range or ROWS_PER_RANGE
    dealt = df.repartitionByRange(max(1, -(-df.count() // size)), *cols) if size else df.repartitionByRange(*cols)
    rows = dealt.sortWithinPartitions(*cols).withColumns({**(counted or {}), _ROW: F.monotonically_increasing_id()})
    if sums:
        rows = rows.mapInArrow(_added_up(sums), rows.schema)
    if tuple(kept) != ("*",):
        rows = rows.select(*kept, _ROW)
    table = written(rows, "ordered", compression)
    return table.withColumns({_RANGE: F.shiftright(_ROW, _ROW_BITS), _ROW: F.col(_ROW).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))})


def placed_in_order(df: DataFrame, order_by: str | Sequence[str], stretches: int) -> DataFrame:
    """`df` with `__stretch`, the number of its range of the order, from 0; some may be empty."""
    cols = _sort_cols(_parse(order_by))
    return df.repartitionByRange(stretches, *cols).withColumn("__stretch", F.spark_partition_id())


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _carries(rows: DataFrame, group_names: list[str], values: list[Column], how: str) -> DataFrame:
    """For each range: its first group, and what the ranges before hold of that group.

    Of each range only the rows of its last group are added up. Ranges that lie within one group add to
    each other, by a window over one row per range.
    """
    group = F.struct(*group_names) if group_names else F.struct(F.lit(0).alias("all"))
    first = rows.filter(F.col(_ROW) == 0).select(_RANGE, group.alias("__ds_first"))
    ends = rows.groupBy(_RANGE).agg(F.max(_ROW).alias("__ds_end"))
    last = rows.join(F.broadcast(ends), _RANGE).filter(F.col(_ROW) == F.col("__ds_end")).select(_RANGE, group.alias("__ds_last"))
    tails = rows.join(F.broadcast(last), _RANGE).filter(group.eqNullSafe(F.col("__ds_last"))).groupBy(_RANGE).agg(
        *[_AGG[how](v).alias(f"__ds_t{i}") for i, v in enumerate(values)])
    by = Window.orderBy(_RANGE)
    goes_on = F.lag("__ds_last").over(by).eqNullSafe(F.col("__ds_first")) & F.lag(F.lit(1)).over(by).isNotNull()
    whole = F.col("__ds_first").eqNullSafe(F.col("__ds_last"))
    borders = first.join(last, _RANGE).join(tails, _RANGE).withColumn("__ds_goes_on", goes_on)
    borders = borders.withColumn("__ds_run", F.sum((~(F.col("__ds_goes_on") & whole)).cast("int")).over(by))
    upto = Window.partitionBy("__ds_run").orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, 0)
    t = [f"__ds_t{i}" for i in range(len(values))]
    borders = borders.withColumns({c: _AGG[how](c).over(upto) for c in t})
    return borders.select(_RANGE, "__ds_first", *[F.when(F.col("__ds_goes_on"), F.lag(c).over(by)).alias(c) for c in t])


def running(
    df: DataFrame,
    value: Column | None,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] = (),
    how: str = "sum",
    inclusive: bool = True,
    out: str = "running",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Running sum, max or min of `value` in `order_by` order, restarting per `partition_by` group.

    `order_by` must be unique inside a group. `value=None` counts rows. With `inclusive=False` a
    row sees only the rows before it (NULL on the first one, 0 for sums).
    """
    return running_many(df, {out: value}, order_by, partition_by, how, inclusive, rows_per_range)


def summed_in_order(
    df: DataFrame, value: Column, order_by: str | Sequence[str], kept: Sequence[Column | str], out: str,
    rows_per_range: int | None = None, compression: str | None = None,
) -> DataFrame:
    """`kept` columns and `out`, the sum of `value` (long) over all rows before a row.

    For wide rows: they travel as they are, and what is kept of them is made in order as the table is written.
    """
    columns = {"__ds_v0": value.cast("long"), "__ds_v0_own": value.cast("long")}
    rows = placed(df, _parse(order_by), rows_per_range, ["__ds_v0"], columns, [*kept, *columns], compression)
    return _global_sums(rows, [out], {out: "__ds_v0"}, inclusive=False)


def running_many(
    df: DataFrame,
    values: dict[str, Column | None],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] = (),
    how: str = "sum",
    inclusive: bool = True,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Several running aggregates over one order: one table, one window."""
    groups, order = _parse(partition_by), _parse(order_by)
    group_names = [k for k, _ in groups]
    names = list(values)
    given = [o for o in names if values[o] is not None]
    held = {o: f"__ds_v{i}" for i, o in enumerate(given)}
    source = df.withColumns({held[o]: values[o] for o in given})
    if groups and not (rows_per_range or ROWS_PER_RANGE) and _largest_group(df, group_names) <= ROWS_PER_GROUP:
        w = Window.partitionBy(*group_names).orderBy(*_sort_cols(order))
        results = {o: _inside(values[o], held.get(o), w, how, inclusive) for o in names}
        if how == "sum":
            results = {o: F.coalesce(c, F.lit(0)) for o, c in results.items()}
        return source.withColumns(results).drop(*held.values())
    kinds = {o: source.schema[held[o]].dataType for o in given}
    if not groups and how == "sum" and all(isinstance(k, (T.IntegralType, T.DoubleType)) for k in kinds.values()):
        whole = {held[o]: F.col(held[o]).cast("long") for o in given if isinstance(kinds[o], T.IntegralType)}
        rows = placed(source.withColumns({**whole, **{f"{held[o]}_own": F.col(held[o]) for o in given}}), order, rows_per_range,
                      list(held.values()))
        return _global_sums(rows, names, held, inclusive)
    rows = placed(source, groups + order, rows_per_range)
    v = [F.lit(1).cast("long") if values[o] is None else F.col(held[o]) for o in names]
    # One row per range.
    carried = rows.join(F.broadcast(_carries(rows, group_names, v, how)), _RANGE)
    w = Window.partitionBy(*group_names, _RANGE).orderBy(_ROW)
    same = F.struct(*group_names).eqNullSafe(F.col("__ds_first")) if group_names else F.lit(True)
    results = {}
    for i, o in enumerate(names):
        inside = _inside(values[o], held.get(o), w, how, inclusive)
        before = F.when(same, F.col(f"__ds_t{i}"))
        if how == "sum":
            results[o] = F.coalesce(inside, F.lit(0)) + F.coalesce(before, F.lit(0))
        elif _is_struct(source, v[i]):
            results[o] = _pick(how, inside, before)
        else:
            results[o] = (F.greatest if how == "max" else F.least)(inside, before)
    return carried.withColumns(results).drop(_RANGE, _ROW, "__ds_first", *[f"__ds_t{i}" for i in range(len(names))], *held.values())


def _largest_group(df: DataFrame, names: list[str]) -> int:
    with cleaned(df.sparkSession):
        return df.groupBy(*names).agg(F.count(F.lit(1)).alias("__ds_n")).agg(F.max("__ds_n")).first()[0] or 0


def _inside(value: Column | None, held: str | None, w, how: str, inclusive: bool) -> Column:
    """A running aggregate over the rows of one window."""
    if value is None and how == "sum":
        return F.row_number().over(w).cast("long") - (0 if inclusive else 1)
    return _AGG[how](F.lit(1).cast("long") if held is None else F.col(held)).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1))


def _global_sums(rows: DataFrame, names: list[str], held: dict[str, str], inclusive: bool) -> DataFrame:
    """Running sums that the table holds for each range, moved by what the ranges before add up to."""
    by = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(_RANGE).agg(
        (F.max(_ROW) + 1).alias("__ds_n"), *[F.max_by(c, _ROW).alias(f"{c}_end") for c in held.values()])
    offsets = ends.select(_RANGE, F.coalesce(F.sum("__ds_n").over(by), F.lit(0)).alias("__ds_start"),
                          *[F.coalesce(F.sum(f"{c}_end").over(by), F.lit(0)).alias(f"{c}_ahead") for c in held.values()])
    results = {}
    for o in names:
        if o in held:
            own = F.lit(0) if inclusive else F.coalesce(F.col(f"{held[o]}_own"), F.lit(0))
            results[o] = F.col(f"{held[o]}_ahead") + F.col(held[o]) - own
        else:
            results[o] = F.col("__ds_start") + F.col(_ROW) + (1 if inclusive else 0)
    spare = [f"{c}{end}" for c in held.values() for end in ("", "_own", "_ahead")]
    # One row per range.
    return rows.join(F.broadcast(offsets), _RANGE).withColumns(results).drop(_RANGE, _ROW, "__ds_start", *spare)


def _is_struct(df: DataFrame, v: Column) -> bool:
    return df.select(v).schema[0].dataType.typeName() == "struct"


def _pick(how: str, a: Column, b: Column) -> Column:
    better = (b > a) if how == "max" else (b < a)
    return F.when(a.isNull() | better, b).otherwise(a)


def global_index(
    df: DataFrame,
    order_by: str | Sequence[str],
    out: str = "pos",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Dense 0-based position of every row in a total order."""
    return running(df, None, order_by, inclusive=False, out=out, rows_per_range=rows_per_range)


def group_index(
    df: DataFrame,
    partition_by: str | Sequence[str],
    order_by: str | Sequence[str],
    out: str = "pos",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Dense 0-based position inside each group, for groups of any size."""
    return running(
        df, None, order_by, partition_by, inclusive=False, out=out, rows_per_range=rows_per_range
    )


def shifted(
    df: DataFrame, partition_by: Sequence[str], pos: str, offset: int, columns: Sequence[str],
    suffix: str,
) -> DataFrame:
    """Columns of the row `offset` positions earlier in the group (negative: later), by equi-join.

    (group, position) is unique, so no key of this join is hot.
    """
    other = df.select(
        *partition_by,
        (F.col(pos) + offset).alias(pos),
        *[F.col(c).alias(c + suffix) for c in columns],
    )
    return df.join(other, [*partition_by, pos], "left")


def slice_bounds(spec: str, total: int) -> tuple[int, int]:
    """Start and end of `[:n]`, `[a:b]`, `[:p%]`, `[p%:]`; percentages are of `total`."""
    lo, hi = spec.strip().strip("[]").split(":")

    def bound(part: str, default: int) -> int:
        part = part.strip()
        if not part:
            return default
        if part.endswith("%"):
            return round(total * float(part[:-1]) / 100)
        n = int(part)
        return max(0, total + n) if n < 0 else min(n, total)

    return bound(lo, 0), bound(hi, total)


def positional_slice(df: DataFrame, spec: str, order_by: str | Sequence[str]) -> DataFrame:
    """Rows of a positional slice; the count runs only for bounds that need it."""
    total = df.count() if "%" in spec or "-" in spec else 2**62
    lo, hi = slice_bounds(spec, total)
    return global_index(df, order_by, "__pos").filter(f"__pos >= {lo} AND __pos < {hi}").drop("__pos")


# Assignments by arithmetic on a position.

def interleaved_shard(pos: Column, world: int) -> Column:
    return pos % world


def interleaved_batch_shard(pos: Column, batch: int, world: int) -> Column:
    return F.floor(pos / batch) % world


def contiguous_shard(pos: Column, total: int, world: int) -> Column:
    return F.floor(pos / (-(-total // world))).cast("long")


def batch_id(pos: Column, size: int) -> Column:
    return F.floor(pos / size).cast("long")


def full_batches_only(df: DataFrame, pos: str, size: int, total: int) -> DataFrame:
    """Drops the short last batch."""
    return df.filter(F.col(pos) < (total // size) * size)


def resume_after(df: DataFrame, pos: str, batches: int, size: int) -> DataFrame:
    return df.filter(F.col(pos) >= batches * size)


def every_kth(df: DataFrame, pos: str, k: int) -> DataFrame:
    return df.filter(F.col(pos) % k == 0)
