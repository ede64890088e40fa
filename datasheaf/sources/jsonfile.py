"""The arrays of large JSON files, read by many tasks.

A file holds one object whose members are arrays of objects, such as an annotation file with its images,
annotations and categories. It is cut into byte ranges. Whether a range begins inside a string, and how
deep, depends on all bytes before it, so a first pass counts in each range, for both cases, how the depth
changes and whether the number of quotes is odd; a row per range settles where each begins. The second
pass returns the elements that begin in a range, reading on to the end of the last one. The elements of
all arrays go to one table, so the file is parsed once for all of them.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datasheaf.session import written

RANGE_BYTES = 32 << 20
# Bytes read before a range to see the key of an array that opens at its start, and read on at a time.
LOOK_BACK, READ_ON = 4096, 1 << 20
QUOTE, BACKSLASH = 34, 92
OPENING, CLOSING = [91, 123], [93, 125]
KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')


def located(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a name as Spark gives it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        uri = "file://" + uri
    return pyarrow.fs.FileSystem.from_uri(uri)


def open_file(uri: str):
    fs, path = located(uri)
    return fs.open_input_file(path)


def read_at(file, lo: int, hi: int) -> bytes:
    return file.read_at(max(0, hi - lo), lo) if hi > lo else b""


def marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the quotes that open or close strings and of all brackets, and the step of depth at each bracket.

    `data` does not begin with an escaped quote.
    """
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(b == QUOTE)
    plain = np.where(b == BACKSLASH, -1, np.arange(len(b)))
    before = np.r_[-1, np.maximum.accumulate(plain)] if len(b) else np.array([-1])
    quotes = at[(at - 1 - before[at]) % 2 == 0]
    opens, closes = np.isin(b, OPENING), np.isin(b, CLOSING)
    brackets = np.flatnonzero(opens | closes)
    return quotes, brackets, np.where(opens[brackets], 1, -1)


def safe_start(file, lo: int) -> int:
    """The latest place at or before `lo` that no backslash stands before."""
    while lo > 0:
        back = read_at(file, max(0, lo - LOOK_BACK), lo)
        kept = back.rstrip(b"\\")
        lo -= len(back) - len(kept)
        if kept:
            break
    return lo


def summary(file, lo: int, hi: int) -> tuple[int, int, int]:
    """Odd number of quotes, change of depth when the range begins outside a string, and inside one."""
    start = safe_start(file, lo)
    data = read_at(file, start, hi)
    quotes, brackets, steps = marks(data)
    quotes, inside = quotes[quotes >= lo - start], brackets >= lo - start
    brackets, steps = brackets[inside], steps[inside]
    odd = np.searchsorted(quotes, brackets) % 2 == 1
    return len(quotes) % 2, int(steps[~odd].sum()), int(steps[odd].sum())


def elements(file, lo: int, hi: int, end: int, in_string: bool, depth: int) -> Iterator[tuple[str | None, bytes | None]]:
    """The elements that begin in the range, each with the name of its array (None: it opened before the range).

    At last the name of the last array that opened in the range, without an element.
    """
    start = safe_start(file, max(0, lo - LOOK_BACK))
    back = read_at(file, start, lo)
    if len(back) and lo - start > len(back):
        raise OSError("short read")
    stop = hi
    while True:
        first = safe_start(file, lo)
        data = read_at(file, first, stop)
        quotes, brackets, steps = marks(data)
        shift = lo - first
        quotes, inside = quotes[quotes >= shift], brackets >= shift
        brackets, steps = brackets[inside], steps[inside]
        outside = (np.searchsorted(quotes, brackets) + in_string) % 2 == 0
        brackets, steps = brackets[outside], steps[outside]
        after = depth + np.cumsum(steps)
        begins = brackets[(steps == 1) & (after == 3) & (brackets < hi - first)]
        ends = brackets[(steps == -1) & (after == 2)]
        # An element that began before this range ends first.
        own_ends = ends[np.searchsorted(ends, begins)] if len(begins) and len(ends) and ends[-1] > begins[-1] else None
        if not len(begins) or own_ends is not None:
            break
        if stop >= end:
            raise ValueError("the file ends inside an element")
        stop = min(end, stop + READ_ON)
    whole = back + data[shift:]
    ahead = len(back)
    opened: list[tuple[int, str]] = []
    for p in brackets[(steps == 1) & (after == 2) & (brackets < hi - first)]:
        at = int(p) - shift + ahead
        key = KEY.search(whole[max(0, at - LOOK_BACK):at])
        opened.append((int(p), key.group(1).decode() if key else ""))
    places = [p for p, _ in opened]
    for p, q in zip(begins, own_ends if own_ends is not None else [], strict=False):
        k = bisect.bisect(places, p)
        yield opened[k - 1][1] if k else None, data[p:q + 1]
    yield opened[-1][1] if opened else None, None


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files that a path or pattern means, those of folders below it as well."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    out = []
    for top in fs.globStatus(p) or []:
        files = fs.listFiles(top.getPath(), True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName()[0] not in "._":
                out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


def json_elements(spark: SparkSession, path: str, names: Sequence[str], range_bytes: int | None = None) -> DataFrame:
    """`name`, `element` (its JSON text) of every object in the arrays `names` of the files at `path`, as a table.

    Elements are objects or arrays. Arrays that are absent or empty give no rows; members that are not
    arrays are passed over.
    """
    size = range_bytes or RANGE_BYTES
    ranges = [(f, k, lo, min(lo + size, n), n) for f, n in listed(spark, path) for k, lo in enumerate(range(0, n, size))]
    schema = "file string, part long, lo long, hi long, size long"
    dealt = spark.createDataFrame(ranges or [], schema).repartition(max(1, len(ranges)), "file", "part")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                with open_file(r["file"]) as f:
                    rows.append((r["file"], r["part"], *summary(f, r["lo"], r["hi"])))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["file", "part", "odd", "outside", "inside"])

    # A row for each range of a file.
    counts = {(r.file, r.part): r for r in dealt.mapInArrow(count, "file string, part long, odd long, outside long, inside long").collect()} if ranges else {}
    begun = []
    for f, k, lo, hi, n in ranges:
        if k == 0:
            in_string, depth = False, 0
        begun.append((f, k, lo, hi, n, in_string, depth))
        c = counts[f, k]
        depth += c.inside if in_string else c.outside
        in_string ^= bool(c.odd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows, held = [], 0
                with open_file(r["file"]) as f:
                    for name, text in elements(f, r["lo"], r["hi"], r["size"], r["in_string"], r["depth"]):
                        rows.append((r["file"], r["part"], name, text))
                        held += len(text or b"")
                        if held > READ_ON:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "part", "name", "element"])

    starts = spark.createDataFrame(begun, schema + ", in_string boolean, depth long").repartition(max(1, len(begun)), "file", "part")
    found = written(starts.mapInArrow(run, "file string, part long, name string, element string"), "json")
    # An array goes on through ranges in which none opens: a row for each range says which.
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opened = found.filter("element IS NULL").select("file", "part", F.last("name", True).over(before).alias("name"))
    whole = found.filter("element IS NOT NULL")
    going_on = whole.filter("name IS NULL").drop("name").join(opened, ["file", "part"])
    return whole.filter("name IS NOT NULL").select("name", "element").unionByName(
        going_on.select("name", "element")).filter(F.col("name").isin(list(names)))
