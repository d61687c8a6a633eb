"""WARC archives: a writer, and a Python data source that reads headers first."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from tidemark.llm.common import fresh_path, staged

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = ("record_type string, record_id string, target_uri string, payload_digest string, refers_to string, "
           "payload_length long, headers map<string,string>, payload binary, path string, offset long")
#: Columns that a filter can be decided on from the header alone, with the header's name.
_HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
            "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


@dataclass(frozen=True)
class WarcParams:
    """Files end after ``file_bytes``; payloads of ``least_payload`` bytes or more are written once."""

    file_bytes: int = 64 << 20
    least_payload: int = 100
    level: int = 5
    date: str = "2024-01-01T00:00:00Z"


def gzip_member(block: bytes, level: int) -> bytes:
    """One gzip member whose extra field ``sl`` holds both its lengths, so a reader can step over it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(block) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    fits = size < 2**32 and len(block) < 2**32
    extra = struct.pack("<H2sHII", 12, b"sl", 8, size, len(block)) if fits else struct.pack("<H", 0)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + extra + body
            + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF))


def _header_value(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_block(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, p: WarcParams) -> bytes:
    """A response, or a revisit of the record of page ``first``: its HTTP headers without the payload."""
    name = "none" if page_id is None else str(page_id)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if first is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
             f"WARC-Date: {p.date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if first is not None:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {_REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, p: WarcParams = WarcParams()) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) and return the list of files (path, n_records).

    Of rows with equal payloads of ``least_payload`` bytes or more, that of the smallest page_id is a response and
    the others revisit it; rows that repeat this id are all responses, as are all of a payload without any
    id.  Null html is an empty payload, a null url leaves out its header.  Only the rows of repeated
    digests are gathered, as minima, so a payload of a third of all rows costs no more.  A repeated attempt of a
    task writes files of other names; only those listed count.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    digests = rows.where(F.octet_length("payload") >= p.least_payload).select("digest", "page_id")
    again = staged(digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                   .where("n > 1 and first is not null").select(F.col("digest").alias("again"), "first"), "digests")
    rows = (rows.join(again, rows["digest"] == again["again"], "left")
            .withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        stream, name, n, size, k = None, "", 0, 0, 0

        def done() -> pd.DataFrame:
            stream.close()
            fs.move(f"{root}/{name}.{token}", f"{root}/{name}")
            return pd.DataFrame({"path": [f"{folder}/{name}"], "n_records": [n]})

        token = uuid.uuid4().hex
        for batch in batches:
            for page_id, url, payload, digest, first in batch.itertuples(index=False):
                if stream is None:
                    name = f"part-{context.partitionId():06d}-{k:05d}-{context.taskAttemptId()}.warc.gz"
                    stream, n, size = fs.open_output_stream(f"{root}/{name}.{token}", compression=None), 0, 0
                ids = [None if pd.isna(x) else int(x) for x in (page_id, first)]
                member = gzip_member(record_block(ids[0], url, payload, digest, ids[1], p), p.level)
                stream.write(member)
                n, size = n + 1, size + len(member)
                if size >= p.file_bytes:
                    yield done()
                    stream, k = None, k + 1
        if stream is not None:
            yield done()

    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return staged(rows.select("page_id", "url", "payload", "digest", "first").mapInPandas(run, "path string, n_records long"),
                  "warc-files")


class _Member:
    """A record at the reader's place: header block first, the rest on demand."""

    def __init__(self, stream, offset: int, compressed: bool):
        self.stream, self.offset, self.compressed = stream, offset, compressed
        self.inflate, self.data, self.next_offset = None, b"", None
        stream.seek(offset)
        if compressed:
            head = stream.read(12)
            flags = head[3]
            extra = stream.read(struct.unpack("<H", head[10:12])[0]) if flags & 4 else b""
            if extra[:2] == b"sl" and len(extra) >= 12:
                self.next_offset = offset + struct.unpack("<I", extra[4:8])[0]
            self.inflate = zlib.decompressobj(31)
            stream.seek(offset)

    def _more(self, most: int = 0) -> bool:
        """Read on: false at the end of the member or the file."""
        if self.inflate is None:
            part = self.stream.read(1 << 16)
            self.data += part
            return bool(part)
        if self.inflate.eof:
            return False
        raw = self.inflate.unconsumed_tail or self.stream.read(1 << 16 if not most else 1 << 12)
        if not raw:
            return False
        self.data += self.inflate.decompress(raw, most)
        return True

    def header(self) -> dict[str, str] | None:
        """Header fields in lower case; None at the end of the file."""
        while b"\r\n\r\n" not in self.data.lstrip(b"\r\n"):
            if not self._more(2048):
                if self.data.strip():
                    raise ValueError(f"record at {self.offset} breaks off")
                return None
        if not self.data.startswith(b"WARC/"):
            lead = len(self.data) - len(self.data.lstrip(b"\r\n"))
            self.data, self.offset = self.data[lead:], self.offset + (0 if self.compressed else lead)
        if not self.data.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {self.offset}")
        head, _, _ = self.data.partition(b"\r\n\r\n")
        self.start = len(head) + 4
        fields = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            fields[key.strip().lower()] = value.strip()
        self.length = int(fields["content-length"])
        return fields

    def block(self) -> bytes:
        parts, have = [self.data], len(self.data)
        while have < self.start + self.length:
            self.data = b""
            if not self._more():
                raise ValueError(f"record at {self.offset} breaks off")
            parts.append(self.data)
            have += len(self.data)
        self.data = b"".join(parts)
        return self.data[self.start:self.start + self.length]

    def following(self) -> int:
        """Offset of the next record, without inflating the payload where lengths are known."""
        if not self.compressed:
            return self.offset + self.start + self.length + 4
        if self.next_offset is not None:
            return self.next_offset
        while not self.inflate.eof:
            self.data = b""
            if not self._more(1 << 16):
                raise ValueError(f"record at {self.offset} breaks off")
        return self.stream.tell() - len(self.inflate.unused_data)


@dataclass
class _Files(InputPartition):
    paths: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("splitbytes", options.get("splitBytes", 128 << 20)))
        self.may_be_empty = options.get("mayBeEmpty", options.get("maybeempty", "false")).lower() == "true"
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        """Equality and membership tests of header columns are decided here, the others by Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in _HEADERS:
                self.wanted.append((column, frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self):
        """Files of the folder and of those below it, small ones together up to ``splitBytes``."""
        fs, root = pa.fs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        if info.type == pa.fs.FileType.File:
            return [_Files([self.path])]
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(f"no such folder: {self.path}")
        found = sorted((f.path, f.size) for f in fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
                       if f.type == pa.fs.FileType.File and f.path.endswith((".warc", ".warc.gz")))
        if not found and not self.may_be_empty:
            raise FileNotFoundError(f"no archive (*.warc, *.warc.gz) in {self.path}")
        groups, size = [], self.split
        for path, n in found:
            if size + n > self.split:
                groups.append([])
                size = 0
            groups[-1].append(f"{self.path.rstrip('/')}/{path[len(root.rstrip('/')) + 1:]}")
            size += n
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition):
        for path in partition.paths:
            fs, place = pa.fs.FileSystem.from_uri(path)
            with fs.open_input_file(place) as stream:
                yield from self._records(stream, path)

    def _records(self, stream, path: str):
        offset, end = 0, stream.size()
        stream.seek(0)
        compressed = stream.read(2) == b"\x1f\x8b"
        while offset < end:
            member = _Member(stream, offset, compressed)
            fields = member.header()
            if fields is None:
                return
            if all(_field(fields, column) in values for column, values in self.wanted):
                yield self._row(member, fields, path)
            offset = member.following()

    def _row(self, member: _Member, fields: dict, path: str) -> tuple:
        length, payload = None, None
        if self.payload or fields.get("content-type", "").startswith("application/http"):
            block = member.block() if self.payload or member.length < 65536 and fields.get("warc-type") == "revisit" else None
            if block is not None and fields.get("content-type", "").startswith("application/http"):
                http, _, body = block.partition(b"\r\n\r\n")
                if m := re.search(rb"(?im)^content-length:\s*(\d+)", http):
                    length = int(m[1])
                payload = body
            else:
                payload = block
        if fields.get("warc-type") == "revisit" or not self.payload:
            payload = None
        elif payload is not None:
            length = len(payload)
        return (*(_field(fields, c) for c in _HEADERS), length, fields, payload, path, member.offset)


def _field(fields: dict, column: str) -> str | None:
    value = fields.get(_HEADERS[column])
    return value.removeprefix("sha256:") if value is not None and column == "payload_digest" else value


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``; option ``payload`` false leaves payloads unread."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read_warc(spark: SparkSession, folder: str, payload: bool = True, may_be_empty: bool = False) -> DataFrame:
    """Records of all archives in a folder and below, plain or gzip, one row each; filters on header columns are pushed down.

    A folder without any archive is an error unless it ``may_be_empty``.  Filters reach the source only with a
    setting of the session, ``spark.sql.python.filterPushdown.enabled``, which is switched on here and stays on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option(
        "mayBeEmpty", str(may_be_empty).lower()).load(folder)


def round_trip(spark: SparkSession, pages: DataFrame, p: WarcParams = WarcParams()) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from archives of ``pages``.

    Responses give length and digest of the payload read; revisits, of which only headers are read, those recorded.
    """
    folder = fresh_path(spark, "warc")
    files = write_warc(pages, folder, p).select("path")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    id_of = lambda c: F.when(number(c) != "", number(c)).cast("long")
    responses = read_warc(spark, folder, may_be_empty=True).where("record_type = 'response'").select(
        "path", id_of("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read_warc(spark, folder, payload=False, may_be_empty=True).where("record_type = 'revisit'").select(
        "path", id_of("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        "payload_digest", "record_type", id_of("refers_to").alias("refers_to"))
    return responses.union(revisits).join(files, "path", "left_semi").drop("path")
