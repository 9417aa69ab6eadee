"""WARC archives as a Python data source (format ``warc``), and deduplicated archiving of pages.

Reading: the driver plans partitions over the archives' files by size. A task
reads a record's header first; pushed-down filters on the record type and on
other header columns are tested on it, and payloads of records that fail, or of
all if the schema has no ``payload``, are passed over unread (by Content-Length,
or in a gzip archive by the member's skip-length field) and never decoded.

Writing: every task writes its own files and rolls over at ``maxFileBytes``; the
driver then commits a manifest of the files of tasks that succeeded, so files of
failed or repeated attempts are never read. Each record is a gzip member of its
own, unless ``compression=none`` is given.

Cases: null or empty payloads are empty blocks; a null url has no header; line
breaks and other control characters in a url are percent-encoded; records of any
length are written alone; an empty table makes an archive without records.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
    LessThanOrEqual, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

#: Payloads below this many bytes are always stored in full.
MIN_REVISIT_BYTES = 100
MAX_FILE_BYTES = 256 << 20
PARTITION_BYTES = 128 << 20
#: WARC needs a date; pages have none.
DATE = "1970-01-01T00:00:00Z"

SCHEMA = ("record_id string, record_type string, target_uri string, date string, content_type string, content_length long, "
          "payload_digest string, payload_bytes long, refers_to string, payload binary")
WRITE_COLUMNS = ("record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload")

_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type",
            "content_length": "content-length", "payload_digest": "warc-payload-digest", "payload_bytes": "x-payload-length", "refers_to": "warc-refers-to"}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_READ = 1 << 20


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def _header_value(text: str) -> str:
    return quote(text, safe="".join(chr(c) for c in range(33, 127)))


def record_bytes(row: dict) -> bytes:
    """One record; the payload of a revisit is left out."""
    payload = row["payload"] or b""
    stored = b"" if row["record_type"] == "revisit" else payload
    block = _HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode() + stored
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", DATE)]
    if row["target_uri"] is not None:
        head.append(("WARC-Target-URI", _header_value(row["target_uri"])))
    head.append(("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"))
    head.append(("X-Payload-Length", str(row["payload_bytes"])))
    if row["refers_to"] is not None:
        head += [("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", _REVISIT)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field "sl" has its own length and that of the data."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Window:
    """Reads at positions of a file through one buffer."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.begin, self.data = file, file.size(), 0, b""

    def at(self, pos: int, n: int) -> bytes:
        if not (self.begin <= pos and pos + n <= self.begin + len(self.data)):
            self.file.seek(pos)
            self.begin, self.data = pos, self.file.read(max(n, _READ))
        return self.data[pos - self.begin:pos - self.begin + n]


def _parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _plain_records(w: _Window, wanted: Callable[[dict], bool], block_wanted: bool) -> Iterator[tuple[dict, bytes]]:
    pos = 0
    while pos < w.size:
        n = 1 << 12
        while (cut := (head := w.at(pos, n)).find(b"\r\n\r\n")) < 0:
            if len(head) < n:
                raise ValueError(f"a record's header ends early at byte {pos}")
            n *= 2
        headers = _parsed(head[:cut])
        begin, length = pos + cut + 4, int(headers["content-length"])
        if wanted(headers):
            yield headers, w.at(begin, length) if block_wanted else b""
        pos = begin + length + 4


def _gzip_records(w: _Window, wanted: Callable[[dict], bool], block_wanted: bool) -> Iterator[tuple[dict, bytes]]:
    pos = 0
    while pos < w.size:
        unpacker, fed, out = zlib.decompressobj(31), 0, bytearray()
        while (cut := out.find(b"\r\n\r\n")) < 0 and not unpacker.eof:
            part = w.at(pos + fed, 1 << 12)
            if not part:
                raise ValueError(f"a record ends early at byte {pos}")
            out += unpacker.decompress(part)
            fed += len(part)
        headers = _parsed(bytes(out[:cut]))
        take, skip = wanted(headers), _skip_length(w.at(pos, 26))
        if skip and not (take and block_wanted):
            if take:
                yield headers, b""
            pos += skip
            continue
        while not unpacker.eof:
            part = w.at(pos + fed, _READ)
            if not part:
                raise ValueError(f"a record ends early at byte {pos}")
            rest = unpacker.decompress(part)
            fed += len(part)
            if take and block_wanted:
                out += rest
        if take:
            yield headers, bytes(out[cut + 4:cut + 4 + int(headers["content-length"])]) if block_wanted else b""
        pos += fed - len(unpacker.unused_data)


def _skip_length(head: bytes) -> int:
    """The member's length by its extra field "sl"; 0 if it has none."""
    if len(head) < 24 or not head[3] & 4 or head[12:14] != b"sl":
        return 0
    return struct.unpack("<I", head[16:20])[0]


def _payload(headers: dict, block: bytes) -> bytes:
    if headers.get("content-type", "").startswith("application/http"):
        return block[block.find(b"\r\n\r\n") + 4:]
    return block


def _value(name: str, headers: dict) -> str | int | None:
    value = headers.get(_HEADERS[name])
    if value is None:
        return None
    if name in ("content_length", "payload_bytes"):
        return int(value)
    return value.removeprefix("sha256:") if name == "payload_digest" else value


_TESTS: dict[type, Callable] = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x), GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x}


@dataclass
class WarcFiles(InputPartition):
    paths: list


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path = schema, options["path"]
        self.target = int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests: list[tuple[str, Callable]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in _HEADERS and type(f) is IsNotNull:
                self.tests.append((name, lambda v: v is not None))
            elif name in _HEADERS and type(f) in _TESTS:
                x = f.prefix if type(f) is StringStartsWith else f.value
                self.tests.append((name, lambda v, test=_TESTS[type(f)], x=x: v is not None and test(v, x)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        where, base = _filesystem(self.path)
        found = where.get_file_info(fs.FileSelector(base)) if where.get_file_info(base).type == fs.FileType.Directory else [where.get_file_info(base)]
        manifests = [f for f in found if f.base_name.startswith("_manifest-")]
        listed = {}
        for m in manifests:
            with where.open_input_stream(m.path) as f:
                listed |= json.loads(f.read())
        files = sorted(listed.items()) if manifests else sorted((f.base_name, f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz")))
        at = base if where.get_file_info(base).type == fs.FileType.Directory else os.path.dirname(base)
        parts: list[list[str]] = []
        room = 0
        for name, size in files:
            if size > room or not parts:
                parts.append([])
                room = self.target
            parts[-1].append(f"{at}/{name}")
            room -= size
        return [WarcFiles(p) for p in parts] or [WarcFiles([])]

    def read(self, partition: WarcFiles) -> Iterator[tuple]:
        where, _ = _filesystem(self.path)
        names, tests = [f.name for f in self.schema], self.tests
        for path in partition.paths:
            with where.open_input_file(path) as f:
                w = _Window(f)
                records = _gzip_records if w.at(0, 2) == b"\x1f\x8b" else _plain_records
                for headers, block in records(w, lambda h: all(t(_value(n, h)) for n, t in tests), "payload" in names):
                    yield tuple(_payload(headers, block) if n == "payload" else _value(n, headers) for n in names)


@dataclass
class WarcWritten(WriterCommitMessage):
    files: dict


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.limit = int(options.get("maxfilebytes", MAX_FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcWritten:
        where, base = _filesystem(self.path)
        where.create_dir(base, recursive=True)
        files: dict[str, int] = {}
        name, out, size = "", None, 0
        for batch in iterator:
            for i in range(len(batch)):
                data = record_bytes({n: batch.column(n)[i].as_py() for n in WRITE_COLUMNS})
                data = gzip_member(data) if self.gzip else data
                if out is None or size + len(data) > self.limit:
                    if out is not None:
                        out.close()
                        files[name] = size
                    name, size = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip, 0
                    out = io.BufferedWriter(where.open_output_stream(f"{base}/{name}", compression=None), 1 << 20)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            files[name] = size
        return WarcWritten(files)

    def commit(self, messages: list) -> None:
        where, base = _filesystem(self.path)
        where.create_dir(base, recursive=True)
        old = [f.path for f in where.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("_manifest-")]
        files = {k: v for m in messages if m is not None for k, v in m.files.items()}
        with where.open_output_stream(f"{base}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(files).encode())
        for path in old if self.overwrite else []:
            where.delete_file(path)

    def abort(self, messages: list) -> None:
        where, base = _filesystem(self.path)
        for m in messages:
            for name in m.files if m is not None else ():
                where.delete_file(f"{base}/{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; options path, compression, maxFileBytes, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self._given())

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self._given(), overwrite)

    def _given(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filter push-down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """Records of the archives at ``path``; ``columns`` is a schema of those wanted (without ``payload`` none is read)."""
    register(spark)
    reader = spark.read.format("warc")
    return (reader.schema(columns) if columns else reader).load(path)


def write_warc(records: DataFrame, path: str, compression: str = "gzip", max_file_bytes: int = MAX_FILE_BYTES) -> None:
    """Write records (WRITE_COLUMNS) as archives at ``path``."""
    register(records.sparkSession)
    (records.select(*WRITE_COLUMNS).write.format("warc").mode("append").option("compression", compression)
     .option("maxFileBytes", max_file_bytes).save(path))


def page_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """A record per page: response, or revisit of the response with the same payload and the smallest page_id.

    Rows that share that smallest page_id (repeated rows) are all responses, as
    is a page without an id when no page with one has its payload.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), body.alias("payload"))
    page = page.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = (page.filter(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first")))
    known = page.join(first, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= min_revisit_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.select(record_id(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
                        "payload_digest", "payload_bytes", F.when(revisit, record_id(F.col("first"))).alias("refers_to"), "payload")


def record_id(page_id):
    """Record id of a page; pages without an id share one."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def page_of(record_id_col):
    """The page id in a record id."""
    return F.regexp_extract(record_id_col, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
