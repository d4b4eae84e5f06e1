"""Operator 7: WARC archives as a Python data source, for reading and writing.

Files are written as gzip with one member a record.  Each member's header carries the ``sl`` extra
field (compressed and plain length of the member), so a reader inflates the record's
headers, and goes on to the next member without inflating a payload nobody asked for.
Other archives, ``.warc.gz`` of any members and plain ``.warc``, are read as streams.

Reading: one partition a group of files of about ``partition_bytes``.  Filters on ``record_type``,
``record_id``, ``target_uri`` and ``payload_digest`` (=, in, is [not] null) are pushed into
the reader and decided on the headers.  ``option("payload", "false")`` returns null payloads,
and inflates none.

Writing: each task writes a file of its own; the commit moves the files of successful
tasks into place, so lost or repeated tasks leave nothing to read.

Nulls: a null payload is written as empty; null ids, addresses and references leave their
header out.  An empty table writes no file.
"""

from __future__ import annotations

import hashlib
import re
import struct
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    WriterCommitMessage,
)

from .common import filesystem, materialise, pick, scratch

SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, "
    "payload_length long, refers_to string, payload binary, file string, offset long"
)
_ARROW = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
        ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("refers_to", pa.string()),
        ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()),
    ]
)
WRITTEN = ("record_id", "record_type", "target_uri", "payload_digest", "payload_length", "refers_to", "payload")
# Fixed values of the WARC/1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PUSHED = ("record_type", "record_id", "target_uri", "payload_digest")
NAMELESS = "urn:nameless:"
_GZIP = struct.Struct("<4sIBBHccHII")
#: Digests of several records are broadcast up to this number, counted first; more are joined.
BROADCAST_ROWS = 500_000
_CLEAN = re.compile(r"[\r\n]+")


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with the skip-length field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = _GZIP.size + len(body) + 8
    head = _GZIP.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"s", b"l", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """The plain bytes of one record; a revisit has the HTTP header alone.  A null id is written as a name of its own, and read as null."""
    payload = (row["payload"] or b"") if row["record_type"] == "response" else b""
    length = len(payload) if row["payload_length"] is None else row["payload_length"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{NAMELESS}{uuid.uuid4()}>" if row["record_id"] is None else f"<urn:record:{row['record_id']}>"), ("WARC-Date", date)]
    head += [("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", row["payload_digest"] and f"sha1:{row['payload_digest']}")]
    if row["record_type"] == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", row["refers_to"] and f"<urn:record:{row['refers_to']}>")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    lines = [VERSION, *(f"{k}: {_CLEAN.sub(' ', v)}".encode() for k, v in head if v is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _fields(block: bytes) -> dict[str, str]:
    """The named fields behind the first line; a line that begins with white space goes on with the field before."""
    out: dict[str, str] = {}
    last = ""
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] = f"{out[last]} {line.strip()}".strip()
            continue
        name, _, value = line.partition(":")
        if last := name.strip().lower():
            out[last] = value.strip()
    return out


def _length(head: dict[str, str]) -> int:
    """The bytes of a record's block; 0 where it tells none."""
    told = head.get("content-length", "")
    return int(told) if told.isdigit() else 0


def _bare(urn: str | None) -> str | None:
    name = urn and urn.strip("<>")
    return None if name and name.startswith(NAMELESS) else name and name.removeprefix("urn:record:")


def _header_of(block: bytes) -> bytes:
    """A block up to its empty line, or all of it."""
    k = block.find(b"\r\n\r\n")
    return block[: k + 4] if k >= 0 else block


class Plain:
    """An archive without compression: bytes are read, or jumped over."""

    def __init__(self, source) -> None:
        self.source, self.at, self.end = source, 0, source.size()

    def more(self) -> bool:
        return self.at < self.end

    def take(self, n: int) -> bytes:
        self.source.seek(self.at)
        data = self.source.read(min(n, self.end - self.at))
        self.at += len(data)
        return data

    def head(self, most: int = 1 << 24) -> bytes:
        """Up to and with the next empty line, but no more than ``most`` bytes."""
        begun, got = self.at, b""
        while b"\r\n\r\n" not in got and self.more() and len(got) < most:
            got += self.take(min(4096, most - len(got)))
        got = _header_of(got)
        self.at = begun + len(got)
        return got

    def skip(self, n: int) -> None:
        self.at += n

    def place(self) -> int:
        return self.at


class Zipped:
    """A gzip archive of any members: one a record, as is usual, or fewer; what is skipped is inflated and dropped."""

    def __init__(self, source) -> None:
        self.source, self.end, self.read = source, source.size(), 0
        self.inflate, self.raw, self.got = zlib.decompressobj(31), b"", b""
        self.member = 0

    def _fill(self) -> bool:
        """Some more plain bytes; False at the end."""
        while True:
            if not self.raw:
                self.source.seek(self.read)
                self.raw = self.source.read(min(1 << 16, self.end - self.read))
                self.read += len(self.raw)
                if not self.raw:
                    return False
            data = self.inflate.decompress(self.raw, 1 << 16)
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.raw = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
                if not self.got and not data:
                    self.member = self.read - len(self.raw)
                elif data:
                    self.got += data
                    return True
                continue
            if data:
                self.got += data
                return True

    def more(self) -> bool:
        if not self.got:
            self.member = self.read - len(self.raw)
        return bool(self.got) or self._fill()

    def take(self, n: int) -> bytes:
        parts, size = [], 0
        while size < n and (self.got or self._fill()):
            parts.append(self.got[: n - size])
            self.got = self.got[n - size :]
            size += len(parts[-1])
        return b"".join(parts)

    def head(self, most: int = 1 << 24) -> bytes:
        while b"\r\n\r\n" not in self.got and len(self.got) < most and self._fill():
            pass
        return self.take(len(_header_of(self.got[:most])))

    def skip(self, n: int) -> None:
        while n > 0 and (self.got or self._fill()):
            n, self.got = n - min(n, len(self.got)), self.got[n:]

    def place(self) -> int:
        return self.member


def _row(head: dict[str, str], web: bytes, name: str, at: int) -> dict:
    """The columns of a record, without its payload."""
    length = _length(head) - len(web)
    told = _fields(web).get("content-length", "") if web else ""
    if head.get("warc-type") == "revisit" and told.isdigit():
        length = int(told)
    return {
        "record_id": _bare(head.get("warc-record-id")), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"),
        "payload_digest": (d := head.get("warc-payload-digest")) and d.removeprefix("sha1:"),
        "payload_length": length, "refers_to": _bare(head.get("warc-refers-to")), "payload": None, "file": name, "offset": at,
    }


def _has_web(head: dict[str, str]) -> bool:
    """Whether the block begins with an HTTP header; its body is the payload then, else the whole block."""
    return head.get("content-type", "").lower().startswith("application/http")


def read_records(source, name: str, wanted=lambda head: True, payload: bool = True) -> Iterator[dict]:
    """Records of an archive, ``.warc`` or ``.warc.gz``; of what ``wanted`` refuses by its headers no payload is kept.

    Members that tell their lengths, as ours do, aren't inflated further than the headers.
    """
    source.seek(0)
    start = source.read(_GZIP.size)
    if start[:4] == b"\x1f\x8b\x08\x04" and len(start) == _GZIP.size and start[12:14] == b"sl":
        yield from _read_skipping(source, name, wanted, payload)
        return
    stream = Zipped(source) if start[:2] == b"\x1f\x8b" else Plain(source)
    while stream.more():
        at = stream.place()
        warc = stream.head()
        if not warc.strip():
            continue
        if not warc.lstrip().startswith(b"WARC/"):
            raise ValueError(f"{name}: no record at {at}")
        head = _fields(warc.lstrip().rstrip(b"\r\n"))
        left = _length(head)
        web = stream.head(left) if left and _has_web(head) else b""
        left -= len(web)
        out = _row(head, web, name, at)
        if wanted(out):
            if payload:
                out["payload"] = stream.take(left)
                left = 0
            stream.skip(left)
            yield out
        else:
            stream.skip(left)


def _read_skipping(source, name: str, wanted, payload: bool) -> Iterator[dict]:
    at, end = 0, source.size()
    while at < end:
        source.seek(at)
        start = source.read(min(4096, end - at))
        magic, _, _, _, extra, s, l, _, size, _ = _GZIP.unpack_from(start)
        if magic != b"\x1f\x8b\x08\x04" or s + l != b"sl":
            raise ValueError(f"{name}: no record with a skip length at {at}, where the ones before had it")
        inflate = zlib.decompressobj(-15)
        body = 12 + extra  # ten bytes, the extra field's length, the extra field
        got, rest = b"", start[body:size]
        used = len(start[:size])
        while got.count(b"\r\n\r\n") < 2 and rest:
            got += inflate.decompress(rest, 4096)
            rest = inflate.unconsumed_tail
            if not rest and used < size and got.count(b"\r\n\r\n") < 2:
                rest = source.read(min(4096, size - used))
                used += len(rest)
        warc, _, tail = got.partition(b"\r\n\r\n")
        head = _fields(warc)
        web = _header_of(tail[: _length(head)]) if _has_web(head) else b""
        out = _row(head, web, name, at)
        if wanted(out):
            if payload:
                source.seek(at)
                data = zlib.decompress(source.read(size)[body:-8], -15)
                begin = len(warc) + 4
                out["payload"] = data[begin + len(web) : begin + _length(head)]
            yield out
        at += size


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.size = int(options.get("partition_bytes", 32 << 20))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column not in PUSHED:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, IsNull):
                self.tests.append((column, "in", (None,)))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "not", (None,)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, path = filesystem(self.folder)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=False))
        groups: list[list[str]] = [[]]
        size = 0
        for info in sorted((x for x in found if x.base_name.endswith((".warc.gz", ".warc"))), key=lambda x: x.base_name):
            if groups[-1] and size + info.size > self.size:
                groups.append([])
                size = 0
            groups[-1].append(info.base_name)
            size += info.size
        return [Files(tuple(g)) for g in groups]

    def wanted(self, head: dict) -> bool:
        return all((head[c] in values) == (kind == "in") for c, kind, values in self.tests)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(self.folder)
        rows: list[dict] = []
        size = 0
        for name in partition.names:
            with fs.open_input_file(f"{path}/{name}") as source:
                for row in read_records(source, name, self.wanted, self.payload):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.level, self.overwrite = options["path"], int(options.get("level", 6)), overwrite
        self.job, self.date = uuid.uuid4().hex, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = filesystem(self.folder)
        name, sink, n = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if sink is None:
                        fs.create_dir(f"{path}/_{self.job}", recursive=True)
                        sink = fs.open_output_stream(f"{path}/_{self.job}/{name}", compression=None)
                    sink.write(member(record(row, self.date), self.level))
                    n += 1
        finally:
            if sink is not None:
                sink.close()
        return Written(name if n else None, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = filesystem(self.folder)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(path)):
                if info.base_name.endswith(".warc.gz"):
                    fs.delete_file(info.path)
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{path}/_{self.job}/{m.name}", f"{path}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = filesystem(self.folder)
        if fs.get_file_info(f"{path}/_{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{path}/_{self.job}")


class WarcDataSource(DataSource):
    """``format("warc")``: read with load(path), write with save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def to_records(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records of pages: of equal payloads the largest id is the response, others revisit it.

    Only payloads of ``least_bytes`` or more revisit.  Pages with a null id are responses, and so are all
    records of the largest id where that is repeated.  Small payloads meet no other; digests of which
    there are several are broadcast, after their number was checked, so the payloads stay where they are.
    """
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    keyed = rows.select("page_id", "url", "html", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("length"))
    large = F.col("length") >= least_bytes
    groups = keyed.where(large & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    groups = materialise(groups.where("n > 1").select("digest", "top"), "equal-payloads")
    if groups.count() <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(groups), "digest", "left")
    else:
        joined = keyed.where(large).join(groups, "digest", "left").unionByName(keyed.where(~large).withColumn("top", F.lit(None).cast(groups.schema["top"].dataType)))
    joined = joined.withColumn("again", F.coalesce(large & (F.col("page_id") < F.col("top")), F.lit(False)))
    return joined.select(
        F.col("page_id").cast("string").alias("record_id"),
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.col("digest").alias("payload_digest"),
        F.col("length").alias("payload_length"),
        F.when(F.col("again"), F.col("top").cast("string")).alias("refers_to"),
        F.when(~F.col("again"), F.col("html")).alias("payload"),
    )


def write_warc(records: DataFrame, folder: str) -> None:
    register(records.sparkSession)
    records.select(*WRITTEN).write.format("warc").mode("append").save(folder)


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def warc_digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages, read them back: a response by its payload, a revisit by its headers."""
    folder = scratch(spark, "warc")
    write_warc(to_records(pages), folder)
    full = read_warc(spark, folder).where("record_type = 'response'")
    bare = read_warc(spark, folder, payload=False).where("record_type = 'revisit'")
    ids = F.col("record_id").cast("long").alias("page_id")
    return full.select(
        ids, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    ).unionAll(bare.select(ids, F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").cast("long")))
