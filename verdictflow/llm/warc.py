"""WARC records in ZIP packages: a writer for round trips, and a reader that range-reads records without extraction.

A package is a ZIP file with stored members: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdxj``, one line per record with its offset and length inside the archive member.  The reader finds the
end-of-central-directory record, follows the ZIP64 locator where a field is saturated, walks the central directory, and
reads the index once to cut it into blocks of lines; each block's task then reads its own lines and their records by byte
range.

Packages are written by the tasks of one job under names of their own attempt; the table of finished packages is what
the job returns, so an attempt that was lost leaves a file that nobody reads.

Edge cases: a null payload is empty; a null id is written as such and never leads a group unless all ids are null; equal
records at the largest id are all responses; an empty table gives no package and an empty result; other columns are not
read; a url is kept whole, null or with control characters; a payload of any length is one record, held in memory by
itself.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, scratch, slices, stored, table

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEAST_BYTES = 1000
PACKAGE_BYTES = 256 << 20
BLOCK_RECORDS = 2048
EPOCH = "2024-01-01T00:00:00Z"
#: Fixed values of the ZIP format.
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


class RangeFile:
    """A file of any file system that pyarrow opens, read by byte range."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.f = fs.open_input_file(path)
        self.size = self.f.size()

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.size:
            raise ValueError(f"range {offset}+{length} is outside the file of {self.size} bytes")
        return self.f.read_at(length, offset)

    def close(self) -> None:
        self.f.close()


def central_directory(f: RangeFile) -> tuple[int, int, int]:
    """Offset, size and entry count, from the end record or, where that is saturated, from the ZIP64 one."""
    tail_size = min(f.size, 22 + FULL16)
    base = f.size - tail_size
    tail = f.read(base, tail_size)
    at = len(tail) - 22
    while at >= 0:
        at = tail.rfind(EOCD, 0, at + 4)
        if at < 0:
            raise ValueError("no end of central directory")
        if at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at -= 1
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, count, size, offset, _ = struct.unpack_from("<4H2IH", tail, at + 4)
    if FULL16 in (count,) or FULL32 in (size, offset):
        where = base + at - 20
        locator = f.read(where, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("the end record is saturated and there is no ZIP64 locator")
        end64 = f.read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != EOCD64:
            raise ValueError("the ZIP64 locator points elsewhere")
        count, size, offset = struct.unpack_from("<3Q", end64, 32)
    return offset, size, count


def members(f: RangeFile) -> dict[str, tuple[int, int, int]]:
    """name -> (method, offset of its data, stored size)."""
    offset, size, count = central_directory(f)
    data, at, out = f.read(offset, size), 0, {}
    for _ in range(count):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", data, at + 10)[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<2I3H", data, at + 20)
        local = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        packed, plain, local = _zip64(extra, packed, plain, local)
        head = f.read(local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"{name}: no local header")
        skip = sum(struct.unpack_from("<2H", head, 26))
        out[name] = (method, local + 30 + skip, packed)
        at += 46 + n_name + n_extra + n_comment
    return out


def _zip64(extra: bytes, packed: int, plain: int, local: int) -> tuple[int, int, int]:
    """The 64-bit values of saturated fields, which stand in this order in extra field 1."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            plain = next(values) if plain == FULL32 else plain
            packed = next(values) if packed == FULL32 else packed
            local = next(values) if local == FULL32 else local
        at += 4 + n
    return packed, plain, local


def stored_range(f: RangeFile, name: str) -> tuple[int, int]:
    method, offset, size = members(f)[name]
    if method:
        raise ValueError(f"{name} is compressed; records can be read by range only from stored members")
    return offset, size


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block, of one WARC record."""
    end = raw.index(b"\r\n\r\n")
    first, *lines = raw[:end].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    n = int(headers["content-length"])
    return headers, raw[end + 4 : end + 4 + n]


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[bytes, str]:
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    one_line = lambda s: "".join(c for c in s if c >= " ")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>",
        "WARC-Date": EPOCH,
        "WARC-Target-URI": one_line(url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
        "X-Page-Url": json.dumps(url),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-Id": str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", kind


class PackageWriter:
    """One package, written front to back; only its index is held in memory."""

    def __init__(self, folder: str, zip64: bool) -> None:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        self.uri, self.lines, self.offset = f"{folder}/{name}", [], 0
        self.out = fs.open_output_stream(f"{path}/{name}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.zip64 = zip64
        self.data = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        record, kind = make_record(page_id, url, payload, digest, refers_to)
        packed = gzip.compress(record, 1, mtime=0)
        self.data.write(packed)
        self.lines.append(json.dumps({"offset": self.offset, "length": len(packed), "type": kind, "digest": f"sha1:{digest}"}))
        self.offset += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=self.zip64) as f:
            for x in self.lines:
                f.write(f"{x}\n".encode())
        self.zip.close()
        self.out.close()
        return self.uri, len(self.lines)


def with_leaders(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """pages (page_id, url, html) with digest and refers_to, and the written table of repeated payloads' leaders.

    Digests are grouped with partial aggregation; only repeated ones stay.  Both sides of the join come from scans, so
    that a payload with very many copies can be split over tasks.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    digests = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("digest"))
    long = F.octet_length(payload) >= least_bytes
    leaders = digests.where(long).groupBy("digest").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    leaders = stored(leaders, "warc-leaders")
    joined = digests.join(leaders, "digest", "left")
    refers: Column = F.when(long & (F.coalesce(F.col("page_id") != F.col("leader"), F.col("leader").isNotNull())), F.col("leader"))
    return joined.select("page_id", "url", payload.alias("payload"), "digest", refers.alias("refers_to")), leaders


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Write records (page_id, url, payload, digest, refers_to) and return the table (uri, records) of whole packages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, payload, digest, refers_to = row
                writer = writer or PackageWriter(folder, zip64)
                writer.add(page_id, url, payload.encode("utf-8"), digest, refers_to)
                if writer.offset >= package_bytes:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["uri", "records"])

    return records.mapInArrow(run, "uri string, records long")


READ_BYTES = 1 << 20


def index_blocks(f: RangeFile, count: int) -> Iterator[tuple[int, int]]:
    """(offset, size) of every count lines of the index, read front to back in bounded pieces."""
    begin, size = stored_range(f, INDEX)
    lines, start, at = 0, 0, 0
    while at < size:
        piece = f.read(begin + at, min(READ_BYTES, size - at))
        cut = piece.find(b"\n")
        while cut >= 0:
            lines += 1
            if lines == count:
                yield begin + start, at + cut + 1 - start
                lines, start = 0, at + cut + 1
            cut = piece.find(b"\n", cut + 1)
        at += len(piece)
    if start < size:
        yield begin + start, size - start


def read_packages(packages: DataFrame, block_records: int = BLOCK_RECORDS) -> DataFrame:
    """One row per record of packages (uri, ...).  The indexes are cut into blocks, which are dealt over tasks."""
    spark = packages.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                f = RangeFile(uri)
                try:
                    data, _ = stored_range(f, ARCHIVE)
                    found = list(index_blocks(f, block_records))
                finally:
                    f.close()
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * n, pa.string()), pa.array([data] * n, pa.int64()), pa.array([a for a, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int64())], ["uri", "data", "at", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, data, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = RangeFile(uri)
                try:
                    yield from _read_block(f, data, f.read(at, size))
                finally:
                    f.close()

    blocks = stored(packages.select("uri").mapInArrow(cut, "uri string, data long, at long, size long"), "warc-blocks")
    n = max(1, min(blocks.count(), 100 * spark.sparkContext.defaultParallelism))
    return blocks.repartition(n).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def _number(s: str | None) -> int | None:
    return int(s) if s else None


def _read_block(f: RangeFile, data: int, lines: bytes) -> Iterator[pa.RecordBatch]:
    """The records of some index lines; data is where the archive member begins."""
    rows = []
    for entry in (json.loads(x) for x in lines.split(b"\n") if x):
        headers, block = parse_record(gzip.decompress(f.read(data + entry["offset"], entry["length"])))
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        n = int(headers["x-payload-length"])
        if headers["warc-type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            n, found = len(payload), hashlib.sha1(payload).hexdigest()
            if found != digest:
                raise ValueError(f"record {headers['warc-record-id']}: payload digest {found}, header {digest}")
        url = json.loads(headers["x-page-url"]) if "x-page-url" in headers else headers["warc-target-uri"]
        rows.append((_number(headers["x-page-id"]), n, digest, headers["warc-type"], _number(headers.get("x-refers-to-page-id")), url))
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records, leaders = with_leaders(pages)
    packages = stored(write_packages(records, scratch(spark, "warc")), "warc-packages")
    discard(leaders)
    return read_packages(packages)


ORACLE = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, url, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS leader FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> leader THEN leader END AS refers_to,
  url
FROM m
"""
