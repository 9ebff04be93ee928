"""WARC archives as a Spark data source, in Python.

Reading plans partitions from the list of files and their sizes. Filters on the record type and on what headers say are
pushed into the reader: it parses a record's headers first, and a record that they rule out is stepped over without
inflating its payload. So are payloads that the asked schema has no column for. Archives are plain, or have a gzip member per
record; members written here hold their own length in an extra field, so stepping over one is a seek.

Writing keeps each task's files apart; only files that the driver's commit names stay, so retried and
speculative tasks leave nothing behind.

Cases: null payloads are empty; a null page_id gives a record without a number and never stands for others unless no
copy has one; rows of equal page_id and payload are of the same type; line ends in addresses are percent-encoded; an empty
table writes and reads no page; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import fresh_path, written

#: Payloads below this many bytes are always stored, however many copies there are.
REVISIT_BYTES = 1000
FILE_BYTES = 128 << 20
PARTITION_BYTES = 64 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: What each column reads from the headers.
FROM_HEADERS = {"record_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id", "date": "warc-date", "refers_to_id": "warc-refers-to", "content_type": "content-type"}
SCHEMA = "record_type string, page_id long, target_uri string, record_id string, date string, content_type string, refers_to_id string, refers_to long, payload_digest string, payload_length long, headers map<string,string>, payload binary, file string, offset long"


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def header_row(headers: dict[str, str]) -> dict:
    """The columns that headers give; digests come as lower-case hexadecimal."""
    row: dict = {c: headers.get(h) for c, h in FROM_HEADERS.items()}
    row["page_id"], row["refers_to"] = _number(row["record_id"]), _number(row["refers_to_id"])
    digest = headers.get("warc-payload-digest", "")
    if digest.startswith("sha1:"):
        value = digest[5:]
        row["payload_digest"] = base64.b32decode(value).hex() if len(value) == 32 else value.lower()
    length = headers.get("x-payload-length")
    row["payload_length"] = int(length) if length else None
    row["headers"] = headers
    return row


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (x.partition(":") for x in lines[1:] if x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def http_payload(block: bytes, headers: dict[str, str]) -> bytes:
    """The body of an HTTP block; other blocks are their own payload."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def record(kind: str, page: int | None, uri: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, date: str) -> bytes:
    """A record as the archive holds it, before compression; a revisit has no payload of its own."""
    urn = f"<urn:page:{'none' if page is None else page}>"
    block = b"" if kind == "revisit" else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    head.append(f"X-Payload-Length: {length}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(date: str) -> bytes:
    block = b"software: glossa\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field 'sl' has its own length and that of the data."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"" if max(total, len(data)) >> 32 else b"sl" + struct.pack("<HII", 8, total, len(data))
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" if extra else b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    return head + (struct.pack("<H", len(extra)) + extra if extra else b"") + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Member:
    """One gzip member of a file: inflates as far as asked, and knows where the next starts."""

    def __init__(self, f, at: int, step: int = 1 << 16):
        self.f, self.at, self.step, self.length = f, at, step, None
        f.seek(at)
        head = f.read(10)
        skip = 10
        if head[3] & 4:
            (n,) = struct.unpack("<H", f.read(2))
            extra = f.read(n)
            skip += 2 + n
            while len(extra) >= 4:
                (size,) = struct.unpack("<H", extra[2:4])
                if extra[:2] == b"sl" and size == 8:
                    self.length = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + size :]
        for flag in (8, 16):  # a name and a comment end with a zero byte
            if head[3] & flag:
                while f.read(1) not in (b"\0", b""):
                    skip += 1
                skip += 1
        if head[3] & 2:
            f.read(2)
            skip += 2
        self.inflate, self.given, self.data, self.read_to = zlib.decompressobj(-15), b"", bytearray(), at + skip

    def need(self, n: int) -> bytearray:
        """The first n bytes of the data, or all there are."""
        while len(self.data) < n and not self.inflate.eof:
            if not self.given:
                self.f.seek(self.read_to)
                self.given = self.f.read(self.step)
                self.read_to += len(self.given)
                if not self.given:
                    raise ValueError(f"a gzip member at {self.at} ends too early")
            self.data += self.inflate.decompress(self.given, n - len(self.data))
            self.given = self.inflate.unconsumed_tail
        return self.data

    def next(self) -> int:
        if self.length:
            return self.at + self.length
        while not self.inflate.eof:  # archives of others don't say how long a member is
            kept = len(self.data)
            self.need(kept + self.step)
            del self.data[kept:]
        return self.read_to - len(self.inflate.unused_data) + 8


def records(f, size: int, wanted, with_payload: bool) -> Iterator[tuple[int, dict, bytes | None]]:
    """(offset, header columns, payload) of a file's records that `wanted` takes by their header columns."""
    at = 0
    while at < size:
        f.seek(at)
        if f.read(2) == b"\x1f\x8b":
            part = _Member(f, at, 1 << 12)
            n = 1 << 10
            while (end := part.need(n).find(b"\r\n\r\n")) < 0 and len(part.data) >= n:
                n *= 2
            if end < 0:
                if part.data.strip():
                    raise ValueError(f"a record at {at} has no end of headers")
                at = part.next()
                continue
            headers = parse_headers(bytes(part.data[:end]))
            row = header_row(headers)
            if wanted(row):
                payload = None
                if with_payload and row["record_type"] != "revisit":
                    part.step = 1 << 16
                    total = end + 4 + int(headers["content-length"])
                    payload = http_payload(bytes(part.need(total)[end + 4 : total]), headers)
                yield at, row, payload
            at = part.next()
        else:
            f.seek(at)
            head, n = b"", 1 << 12
            while (end := head.find(b"\r\n\r\n")) < 0 and (more := f.read(n)):
                head += more
            if end < 0:
                if head.strip():
                    raise ValueError(f"a record at {at} has no end of headers")
                return
            headers = parse_headers(head[:end].lstrip(b"\r\n"))
            row, body, length = header_row(headers), at + end + 4, int(headers["content-length"])
            if wanted(row):
                payload = None
                if with_payload and row["record_type"] != "revisit":
                    f.seek(body)
                    payload = http_payload(f.read(length), headers)
                yield at, row, payload
            at = body + length + 4


PUSHED = ("record_type", "page_id", "target_uri", "record_id", "date", "content_type", "refers_to_id", "refers_to", "payload_digest", "payload_length")
_TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringContains: lambda x, v: v in x,
}


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.tests = path, schema, []

    def pushFilters(self, filters: list[Filter]):
        for one in filters:
            column = getattr(one, "attribute", (None,))
            if len(column) == 1 and column[0] in PUSHED and (type(one) in _TESTS or isinstance(one, IsNotNull)):
                self.tests.append((column[0], type(one), getattr(one, "value", None)))
            else:
                yield one

    def wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            x = row.get(column)
            if x is None or (kind in _TESTS and not _TESTS[kind](x, value)):
                return False
        return True

    def partitions(self) -> list[Files]:
        where, path = fs.FileSystem.from_uri(self.path)
        found = where.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        found = sorted((x.path, x.size) for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz")) and not x.base_name.startswith(("_", ".")))
        out: list[list[tuple[str, int]]] = []
        room = 0
        for name, size in found:
            if not out or size > room:
                out.append([])
                room = PARTITION_BYTES
            out[-1].append((name, size))
            room -= size
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        where, _ = fs.FileSystem.from_uri(self.path)
        names = self.schema.names
        for name, size in partition.files:
            with where.open_input_file(name) as f:
                for offset, row, payload in records(f, size, self.wanted, "payload" in names):
                    row |= {"payload": payload, "file": name, "offset": offset}
                    yield tuple(row.get(c) for c in names)


@dataclass
class Wrote(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str):
        self.path, self.date = path, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        where, path = fs.FileSystem.from_uri(self.path)
        where.create_dir(path, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                columns = [batch.column(c).to_pylist() for c in ("record_type", "page_id", "target_uri", "payload", "payload_digest", "payload_length", "refers_to")]
                for kind, page, uri, payload, digest, length, refers_to in zip(*columns, strict=True):
                    if out is None or size > FILE_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"{path}/part-{uuid.uuid4().hex}.warc.gz")
                        out, size = where.open_output_stream(names[-1], compression=None), 0
                        out.write(member(info_record(self.date)))
                    data = member(record(kind, page, uri, payload or b"", digest, length, refers_to, self.date))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Wrote(names)

    def _files(self) -> tuple[fs.FileSystem, list[str]]:
        where, path = fs.FileSystem.from_uri(self.path)
        return where, [x.path for x in where.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if x.is_file]

    def commit(self, messages: list[Wrote | None]) -> None:
        kept = {name for m in messages if m for name in m.files}
        where, found = self._files()
        for name in found:
            if name not in kept:
                where.delete_file(name)

    def abort(self, messages: list[Wrote | None]) -> None:
        where, found = self._files()
        for name in found:
            where.delete_file(name)


class WarcSource(DataSource):
    """format("warc"): option `path`; for writing also `date`. Give a schema without `payload` to read headers alone."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"))


def register(spark) -> None:
    """Make format("warc") known to the session, with filter pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def described(pages: DataFrame) -> DataFrame:
    """A record for each page: of equal payloads of REVISIT_BYTES or more, that with the largest page_id is stored."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    large = rows.where(F.col("payload_length") >= REVISIT_BYTES)
    stored = large.groupBy("payload_digest").agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND stored IS NOT NULL")
    stored = written(stored.select("payload_digest", "stored"), "stored-payloads")
    rows = rows.join(stored, "payload_digest", "left")
    revisit = F.col("stored").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "page_id", "target_uri", F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_digest", "payload_length", F.when(revisit, F.col("stored")).alias("refers_to"),
    )


def archived(pages: DataFrame, path: str) -> DataFrame:
    """Write the pages' archives to `path`; the pages' records as read back from there."""
    spark = pages.sparkSession
    register(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    described(pages).write.format("warc").option("path", path).mode("append").save()
    back = spark.read.format("warc").option("path", path).load()
    return back.where(F.col("record_type").isin("response", "revisit"))


def query(pages: DataFrame) -> DataFrame:
    back = archived(pages, fresh_path(pages.sparkSession, "warc"))
    whole = F.col("record_type") == "response"  # what is stored is measured anew, not taken from its headers
    return back.select(
        "page_id",
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
