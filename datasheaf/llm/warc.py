"""WARC archives with a two-level capture index.

Archives are written by the tasks as .warc.gz files, one gzip member for each record. The index sorts
captures by reversed-host URL key into compressed blocks and keeps a sparse directory with the first and
last key of each block. A lookup searches the directory and then the block by bisection, and reads just
the byte range of the record. Folders are named by URI; tasks open them through pyarrow's file systems.
A task that runs twice writes files of its own, and only those of the finished attempt are indexed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datasheaf.llm.common import SMALL_ROWS, spread_count, written

BLOCK_CAPTURES = 3000
ARCHIVE_BYTES = 1 << 30
READ_AHEAD = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "key string, page_id long, file string, offset long, length long"
PLACE_SCHEMA = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
CAPTURE_SCHEMA = pa.schema([
    ("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
DIRECTORY = "first_key string, last_key string, captures int, file string, offset long, length long"
DIRECTORY_SCHEMA = pa.schema([
    ("first_key", pa.string()), ("last_key", pa.string()), ("captures", pa.int32()), ("file", pa.string()),
    ("offset", pa.int64()), ("length", pa.int64())])
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
RECORD_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def url_key(url: Column) -> Column:
    """`com,example,www)/path?query`: labels of the host reversed, fragment dropped; empty without `://`."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.when(F.contains(u, F.lit("://")), F.regexp_replace(key, r"[\t\r\n]", " ")).otherwise("")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if refers_to is None else head
    name = "null" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
             f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse(data: bytes) -> tuple:
    """Row of RECORD_SCHEMA of a record's bytes; a payload must match its digest."""
    head, rest = zlib.decompress(data, 31).split(b"\r\n\r\n", 1)
    h = fields(head)
    number = lambda v: None if v is None or v == "<urn:page:null>" else int(v[len("<urn:page:"):-1])
    http, payload = rest[:int(h["Content-Length"])].split(b"\r\n\r\n", 1)
    size, digest, kind = int(fields(http)["Content-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"record {h['WARC-Record-ID']} does not match its digest")
    return (number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), size, digest, kind, number(h.get("WARC-Refers-To")),
            payload if kind == "response" else None)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class Appender:
    """Files of a task in one folder; `add` returns where the bytes went."""

    def __init__(self, folder: str, suffix: str, most: int = ARCHIVE_BYTES, opening: bytes = b""):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.path)
        self.suffix, self.most, self.opening, self.out = suffix, most, opening, None

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= self.most:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", len(self.opening)
            self.out = self.store.open_output_stream(f"{self.path}/{self.name}", compression=None)
            self.out.write(self.opening)
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return self.name, at, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """Archives of `pages` (page_id, url, html) in `folder`; returns the captures (key, page_id, file, offset, length).

    Of rows with equal payloads of at least `least_bytes` bytes, the one with the smallest page_id is a
    response (all rows with that id, if it is repeated) and the others are revisits of it; rows without an
    id count as larger than any. A null html is an empty payload, a null url leaves the target out.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    long_enough = F.length("payload") >= least_bytes
    digests = rows.filter(long_enough).groupBy(F.sha1("payload").alias("digest"))
    firsts = digests.agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 and first is not null")
    firsts = written(firsts.select("digest", "first"), "warc-firsts")
    known = firsts.count()
    small = F.broadcast(firsts) if known <= SMALL_ROWS else firsts
    rows = rows.withColumn("digest", F.when(long_enough, F.sha1("payload"))).join(small, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select(url_key(F.col("url")).alias("key"), "page_id", "url", "payload", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = "software: datasheaf\r\nformat: WARC File Format 1.1\r\n".encode()
        opening = member(
            f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
        files = Appender(folder, ".warc.gz", opening=opening)
        for b in batches:
            out = []
            for key, page, url, payload, refers in zip(*[b[c] for c in ("key", "page_id", "url", "payload", "refers_to")], strict=True):
                data = member(record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py(), date))
                out.append((key.as_py(), page.as_py(), *files.add(data)))
            if out:
                yield batch(out, CAPTURE_SCHEMA)
        files.close()

    return written(rows.mapInArrow(write, CAPTURES), "warc-captures")


def build_index(captures: DataFrame, folder: str, block_captures: int = BLOCK_CAPTURES) -> DataFrame:
    """Blocks of the sorted captures in `folder`; returns their directory, also kept in `folder`/directory.

    Captures of one key may fill many blocks, in several ranges.
    """
    keys = ["key", "page_id", "file", "offset"]
    rows = captures.repartitionByRange(spread_count(captures.sparkSession), *keys).sortWithinPartitions(*keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held = Appender(folder, ".cdx"), []
        def block() -> tuple:
            lines = "\n".join("\t".join("" if v is None else str(v) for v in r) for r in held)
            return held[0][0], held[-1][0], len(held), *files.add(zlib.compress(lines.encode(), 6))
        for b in batches:
            out = []
            for r in zip(*[b[c].to_pylist() for c in CAPTURE_SCHEMA.names], strict=True):
                held.append(r)
                if len(held) == block_captures:
                    out.append(block())
                    held = []
            if out:
                yield batch(out, DIRECTORY_SCHEMA)
        if held:
            yield batch([block()], DIRECTORY_SCHEMA)
        files.close()

    rows.mapInArrow(pack, DIRECTORY).write.parquet(f"{folder}/directory")
    return captures.sparkSession.read.parquet(f"{folder}/directory")


def lookup(urls: DataFrame, folder: str) -> DataFrame:
    """Captures of every url of `urls` (url), each url once; a null url finds the captures without one.

    The urls are sorted, so a task searches the part of the directory between its first and last key. The
    blocks that it finds for each key are dealt out before they are read: each block is read once, and the
    many blocks of one frequent key are read by many tasks.
    """
    keys = urls.select(url_key(F.col("url")).alias("key")).distinct()
    keys = keys.repartitionByRange(spread_count(urls.sparkSession), "key").sortWithinPartitions("key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        directory = None
        for b in batches:
            if not b.num_rows:
                continue
            wanted = b["key"].to_pylist()
            directory = directory or ds.dataset(f"{path}/directory", filesystem=store, format="parquet", exclude_invalid_files=True)
            near = directory.to_table(filter=(ds.field("last_key") >= wanted[0]) & (ds.field("first_key") <= wanted[-1]))
            blocks = sorted(zip(*[near[c].to_pylist() for c in DIRECTORY_SCHEMA.names], strict=True), key=lambda r: (r[1].encode(), r[0].encode()))
            lasts = [r[1].encode() for r in blocks]
            out = []
            for key in wanted:
                k = key.encode()
                for first, _, _, file, offset, length in blocks[bisect_left(lasts, k):]:
                    if first.encode() > k:
                        break
                    out.append((key, file, offset, length))
                    if len(out) >= 10_000:
                        yield batch(out, PLACE_SCHEMA)
                        out = []
            if out:
                yield batch(out, PLACE_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        name, lines = None, []
        for b in batches:
            out = []
            for key, file, offset, length in zip(*[b[c].to_pylist() for c in PLACE_SCHEMA.names], strict=True):
                k = key.encode()
                if name != (file, offset):
                    with store.open_input_file(f"{path}/{file}") as f:
                        lines = zlib.decompress(f.read_at(length, offset)).split(b"\n")
                    name = file, offset
                # By the key alone: a character below the tab would order whole lines otherwise.
                i = bisect_left(lines, k, key=lambda line: line[:line.index(b"\t")])
                while i < len(lines) and lines[i].startswith(k + b"\t"):
                    _, page, where, at, size = lines[i].decode().split("\t")
                    out.append((key, int(page) if page else None, where, int(at), int(size)))
                    i += 1
                if len(out) >= 10_000:
                    yield batch(out, CAPTURE_SCHEMA)
                    out = []
            if out:
                yield batch(out, CAPTURE_SCHEMA)

    places = keys.mapInArrow(search, "key string, file string, offset long, length long")
    dealt = places.repartition(spread_count(urls.sparkSession), "file", "offset").sortWithinPartitions("file", "offset", "key")
    return dealt.mapInArrow(read, CAPTURES)


def read_captures(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records at the captures' byte ranges; neighbouring ranges of a file are fetched together.

    Without `payloads` the column stays null; it is checked against its digest in any case.
    """
    rows = captures.repartitionByRange(spread_count(captures.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for b in batches:
            places = list(zip(*[b[c].to_pylist() for c in ("file", "offset", "length")], strict=True))
            at = 0
            while at < len(places):
                file, start, size = places[at]
                to, end = at + 1, start + size
                while to < len(places) and places[to][0] == file and places[to][1] == end and end - start < READ_AHEAD:
                    end += places[to][2]
                    to += 1
                with store.open_input_file(f"{path}/{file}") as f:
                    data = memoryview(f.read_at(end - start, start))
                out = [parse(data[o - start:o - start + n]) for _, o, n in places[at:to]]
                yield batch(out if payloads else [(*r[:-1], None) for r in out], RECORD_SCHEMA)
                at = to

    return rows.mapInArrow(read, RECORDS)


def archive_and_read(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write `pages`, index them, look every url up again and read the records that are found."""
    archives, index = f"{folder}/archives", f"{folder}/index"
    captures = write_archives(pages, archives)
    build_index(captures, index)
    return read_captures(lookup(pages.select("url"), index), archives, payloads=False)
