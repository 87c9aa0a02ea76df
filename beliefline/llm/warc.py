"""WARC archives as a Python data source, and their writing with revisit records for equal payloads.

Records are gzip members. A member's header carries the extra field ``sl`` with its compressed and uncompressed
lengths, so a reader that does not want a record seeks past it without inflating it. The reader plans a partition for
each file, takes equality and IN predicates on record type and headers from Spark, parses the WARC headers first and
inflates a payload only if the record passes and payloads are asked for. Plain gzip members and uncompressed archives
are read as well.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

SCHEMA = "record_id string, record_type string, refers_to string, target_uri string, payload_digest string, payload_bytes long, computed_digest string, payload binary"
_ARROW = pa.schema([*((c, pa.string()) for c in ("record_id", "record_type", "refers_to", "target_uri", "payload_digest")), ("payload_bytes", pa.int64()), ("computed_digest", pa.string()), ("payload", pa.binary())])
_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest"}
FILE_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
#: A fixed date keeps archives of equal input equal.
DATE = "2000-01-01T00:00:00Z"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it: local for file: and bare paths, else by the address."""
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path if scheme else path
    return pafs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, level: int) -> bytes:
    """A gzip member with the lengths in its header."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(record) + press.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(record_id: str, kind: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response or revisit record. Both hold the HTTP header with the payload's length; a revisit leaves it at that."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    clean = "" if uri is None else uri.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    """Tasks write hidden files; the commit gives them their names, an abort deletes them."""

    def __init__(self, options: dict):
        self.path, self.level = options["path"], int(options.get("level", "4"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = uuid.uuid4().hex
                    files.append((f"{root}/_{name}.tmp", f"{root}/{name}.warc.gz"))
                    out, size = fs.open_output_stream(files[-1][0], compression=None), 0
                data = member(record(r["record_id"], r["record_type"], r["target_uri"], r["payload"] or b"", r["refers_to"]), self.level)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for hidden, name in m.files if m else ():
                fs.move(hidden, name)

    def abort(self, messages: list) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            for hidden, _ in m.files if m else ():
                fs.delete_file(hidden)


class _Stream:
    """Successive records of a file: headers first, the rest on demand."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at = source, size, 0

    def _peek(self, n: int) -> bytes:
        self.source.seek(self.at)
        return self.source.read(n)

    def records(self) -> Iterator[tuple[dict[str, str], callable]]:
        """(headers, a function that gives the block); unread blocks are skipped."""
        while self.at < self.size:
            start = self._peek(64)
            if start[:2] == b"\x1f\x8b":
                yield from self._member(start)
            elif start.startswith(b"WARC/"):
                yield from self._plain()
            elif start.strip(b"\r\n") == b"" and start:
                self.at += len(start)
            elif start[:1] in b"\r\n":
                self.at += 1
            else:
                raise ValueError(f"no WARC record at byte {self.at}")

    def _member(self, start: bytes) -> Iterator:
        length = None
        if start[3] & 4:
            (n,) = struct.unpack("<H", start[10:12])
            extra = start[12 : 12 + n]
            if extra[:2] == b"sl":
                (length,) = struct.unpack("<I", extra[4:8])
        inflate, begin, at = zlib.decompressobj(31), self.at, self.at
        data = b""
        while b"\r\n\r\n" not in data and not inflate.eof:
            self.source.seek(at)
            more = inflate.unconsumed_tail or self.source.read(4096)
            at += 0 if inflate.unconsumed_tail else len(more)
            if not more:
                raise ValueError("a record ends early")
            data += inflate.decompress(more, 1024)
        state = {"data": data, "at": at}

        def rest() -> bytes:
            parts = [state["data"]]
            while not inflate.eof:
                if inflate.unconsumed_tail:
                    parts.append(inflate.decompress(inflate.unconsumed_tail))
                    continue
                self.source.seek(state["at"])
                more = self.source.read(1 << 16)
                if not more:
                    raise ValueError("a record ends early")
                state["at"] += len(more)
                parts.append(inflate.decompress(more))
            state["data"] = b"".join(parts)
            return state["data"]

        head, _, _ = data.partition(b"\r\n\r\n")
        headers = _parse(head)

        def block() -> bytes:
            body = rest()[len(head) + 4 :]
            return body[: int(headers.get("content-length", len(body)))]

        yield headers, block, data[len(head) + 4 :]
        if length is None:
            rest()
            length = state["at"] - len(inflate.unused_data) - begin
        self.at = begin + length

    def _plain(self) -> Iterator:
        data, begin = b"", self.at
        while b"\r\n\r\n" not in data:
            self.source.seek(begin + len(data))
            more = self.source.read(4096)
            if not more:
                raise ValueError("a record ends early")
            data += more
        head, _, after = data.partition(b"\r\n\r\n")
        headers = _parse(head)
        n = int(headers["content-length"])

        def block() -> bytes:
            self.source.seek(begin + len(head) + 4)
            return self.source.read(n)

        yield headers, block, after[:n]
        self.at = begin + len(head) + 4 + n + 4


def _parse(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _bare(name: str, value: str | None) -> str | None:
    if value is None:
        return None
    if name == "payload_digest":
        return value.removeprefix("sha1:")
    if name in ("record_id", "refers_to"):
        return value.removeprefix("<urn:page:").removeprefix("<").removesuffix(">")
    return value


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        """Equality and IN on the columns that headers give; Spark keeps the others."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in _HEADERS and isinstance(f, EqualTo):
                values = {f.value}
            elif name in _HEADERS and isinstance(f, In):
                values = set(f.value)
            else:
                yield f
                continue
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def partitions(self) -> list[InputPartition]:
        fs, root = file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if fs.get_file_info(root).type != pafs.FileType.File else [fs.get_file_info(root)]
        names = sorted(f.path for f in found if f.type == pafs.FileType.File and not os.path.basename(f.path).startswith(("_", ".")) and f.path.endswith((".warc", ".warc.gz")))
        return [_File(n) for n in names] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = file_system(self.path)
        rows, size = [], 0
        with fs.open_input_file(partition.path) as source:
            for headers, block, begun in _Stream(source, source.size()).records():
                row = {c: _bare(c, headers.get(h)) for c, h in _HEADERS.items()}
                if any(row[c] not in values for c, values in self.wanted.items()):
                    continue
                response = row["record_type"] == "response"
                body = block() if self.payload and response else begun
                http, found, payload = body.partition(b"\r\n\r\n")
                if not found and not (self.payload and response):  # the HTTP header goes on beyond what was inflated
                    http, found, payload = (body := block()).partition(b"\r\n\r\n")
                length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), None)
                row |= {"payload_bytes": length, "computed_digest": digest(payload) if self.payload and response else None, "payload": payload if self.payload and response else None}
                rows.append(row)
                size += len(body)
                if size >= BATCH_BYTES or len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcSource(DataSource):
    """Format ``warc``; options: path, payload (false: no payload is inflated), level (of compression)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


def with_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """The records to write: record_id, record_type, target_uri, payload, refers_to.

    Of rows with equal payloads of ``least`` bytes or more, the one with the largest id is the response and the others
    revisit it; smaller payloads are all responses. A null payload is empty. Rows that repeat the largest id are all
    responses; a row with a null id revisits the largest id of its payload, if there is one. Payloads are compared by
    SHA-1 and length; groups are found by an aggregation, and only rows travel, never pairs. Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("sum", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    shared = rows.where(F.col("n") >= least).groupBy("sum", "n").agg(F.max("id").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null")
    joined = rows.join(shared, ["sum", "n"], "left")
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")), F.lit(False))
    return joined.select(
        F.col("id").cast("string").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        "payload",
        F.when(again, F.col("first").cast("string")).alias("refers_to"),
    )


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of Hadoop's default file system, if it has none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def write(records: DataFrame, path: str, *, level: int = 4) -> None:
    path = qualified(register(records.sparkSession), path)
    records.write.format("warc").mode("append").option("level", str(level)).save(path)


def read(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    return register(spark).read.format("warc").option("payload", str(payload).lower()).load(qualified(spark, path))


#: The same as the query in DuckDB's SQL; base 32 by blocks of five bits.
ORACLE = r"""
with p as (select page_id, sha1(coalesce(html, '')) as h, octet_length(encode(coalesce(html, '')))::bigint as n from pages),
g as (select *, max(page_id) over (partition by h, n) as first from p),
b as (select *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 1 + 5 * i, 5))::bigint) as quads from g)
select page_id, n as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((quads[1 + i // 4] >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from b
"""
