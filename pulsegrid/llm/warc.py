"""WARC archives as a Spark data source, and archives of pages in which equal payloads are kept once.

``Warc`` is a Python data source (format ``warc``).

* Planning: the writer leaves a manifest with the files of the committed tasks, their sizes and record boundaries at every ``SPLIT`` bytes, so a file is read by
  as many tasks as its size asks for, and files of failed or repeated attempts are never read.  A folder or file without manifest is listed; each file is a partition.
* Push-down: comparisons, IN, null tests, string prefixes, suffixes and parts, and their negations on any header column decide in the source.
* Reading: headers first.  Of a record that the predicates refuse, or whose payload nobody asked for, only the header bytes are inflated; the rest of the
  record is skipped by its length, which the gzip member states in the ``sl`` extra field (members without it are inflated to their end, in pieces).
  Spark hands no column pruning to Python sources, so the payload is asked for by naming it in the schema of the reader.

``write_pages`` groups pages by payload digest: the page with the least id is a ``response``, the others are ``revisit`` records that refer to it and hold the HTTP header
only.  Digests borne by at least one page in ``HOT`` are at most ``HOT`` many and are joined by broadcast; all others meet in a shuffle in which no key has more rows than that.

Null texts are empty payloads.  A page without id is never referred to while its group holds one with an id; a group without any id is all responses, and so are
rows repeated under the group's least id.  A null url is left out.  Extra columns are not archived.  An empty table is an archive without files.
Long payloads: a record is built and read in memory, one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull,
                                    LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

from pulsegrid.llm.common import write_once

MANIFEST = "_manifest.json"
SPLIT = 32 << 20
FILE_BYTES = 512 << 20
CHUNK = 1 << 16
HOT = 1000
BATCH_BYTES = 4 << 20
#: Lengths from here on are not stated in the ``sl`` field of 32 bits.
UNSTATED = 0xF0000000

#: Header names of the format, by column.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "refers_to": "WARC-Refers-To",
           "payload_digest": "WARC-Payload-Digest", "profile": "WARC-Profile", "content_type": "Content-Type", "content_length": "Content-Length"}
#: Fixed value: profile of a revisit whose payload is the same.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, profile string, content_type string, content_length long, " \
         "payload_bytes long, intact boolean, payload binary"
RECORD = "record_type string, record_id string, target_uri string, refers_to string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


# --- records ---


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """One record: its header, then the HTTP header and, unless it is a revisit, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {SAME_PAYLOAD}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member whose ``sl`` field states its compressed and plain length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sH", 12, b"sl", 8)
    total = len(head) + 8 + len(body) + 8
    return head + struct.pack("<II", min(total, UNSTATED), min(len(data), UNSTATED)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


# --- reading ---


class Plain:
    """Bytes of an open file from a place on, with a small look-ahead."""

    def __init__(self, file, at: int):
        self.file, self.held, self.at = file, b"", at
        file.seek(at)

    def more(self) -> bool:
        data = self.file.read(CHUNK)
        self.held += data
        return bool(data)

    def take(self, n: int) -> bytes:
        parts, need = [self.held[:n]], n - len(self.held)
        self.held = self.held[n:]
        while need > 0 and (data := self.file.read(max(need, CHUNK))):
            parts.append(data[:need])
            self.held = data[need:]
            need -= len(data)
        self.at += n
        return b"".join(parts)

    def skip(self, n: int) -> None:
        self.at += n
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.held = b""
            self.file.seek(self.at)


def parsed(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name, continuation lines joined."""
    out: dict[str, str] = {}
    name = None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def http_parts(block: bytes) -> tuple[dict[str, str], int]:
    """Fields of the HTTP header and where the payload starts; a block that is no HTTP message is payload from its start."""
    end = block.find(b"\r\n\r\n")
    return (parsed(block[:end]), end + 4) if block[:5] == b"HTTP/" and end >= 0 else ({}, 0)


class PlainRecord:
    """A record of an uncompressed file; ``block`` reads the rest, ``skip`` jumps over it."""

    def __init__(self, source: Plain):
        while (end := source.held.find(b"\r\n\r\n")) < 0:
            if not source.more():
                raise ValueError("the file ends inside a record header")
        self.source, self.fields = source, parsed(source.take(end + 4)[:-4])
        self.length = int(self.fields["content-length"])

    def block(self, limit: int | None = None) -> bytes:
        n = self.length if limit is None else min(limit, self.length)
        data = self.source.take(n)
        self.source.skip(self.length - n + 4)
        return data


class PackedRecord:
    """A record in a gzip member of its own: the header is inflated first, the block on demand."""

    def __init__(self, source: Plain):
        self.source, self.start = source, source.at
        while len(source.held) < 24 and source.more():
            pass
        self.total = None
        if source.held[3:4] == b"\x04" and source.held[12:16] == struct.pack("<2sH", b"sl", 8):
            total, plain = struct.unpack_from("<II", source.held, 16)
            self.total = total if max(total, plain) < UNSTATED else None
        self.inflate, self.plain = zlib.decompressobj(31), b""
        while (end := self.plain.find(b"\r\n\r\n")) < 0:
            self._more(CHUNK)
        self.fields, self.plain = parsed(self.plain[:end]), self.plain[end + 4:]
        self.length = int(self.fields["content-length"])

    def _more(self, limit: int) -> None:
        data = self.inflate.unconsumed_tail or self.source.take(min(CHUNK, self.total - (self.source.at - self.start)) if self.total else CHUNK)
        if not data:
            raise ValueError("the file ends inside a record")
        self.plain += self.inflate.decompress(data, limit)

    def block(self, limit: int | None = None) -> bytes:
        n = self.length if limit is None else min(limit, self.length)
        parts, have = [self.plain], len(self.plain)
        while have < n:
            self.plain = b""
            self._more(max(CHUNK, n - have) if limit is None else CHUNK)
            parts.append(self.plain)
            have += len(self.plain)
        if self.total is not None:
            self.source.skip(self.start + self.total - self.source.at)
        else:
            while not self.inflate.eof:
                self.plain = b""
                self._more(CHUNK)
            unused = self.inflate.unused_data
            self.source.held, self.source.at = unused + self.source.held, self.source.at - len(unused)
        return b"".join(parts)[:n]


@dataclass
class Span(InputPartition):
    """Bytes ``start`` to ``stop`` of a file, both at record boundaries; no stop: to the end."""

    path: str
    start: int
    stop: int | None

    def __init__(self, path: str, start: int, stop: int | None):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


def records(file, start: int, stop: int | None) -> Iterator[PlainRecord | PackedRecord]:
    """Records of a span.  The caller must take each one's block before asking for the next."""
    source = Plain(file, start)
    while (stop is None or source.at < stop) and (source.held or source.more()):
        yield PackedRecord(source) if source.held[:1] == b"\x1f" else PlainRecord(source)


_COMPARE = {EqualTo: lambda a, b: a == b, EqualNullSafe: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
            LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda a, b: b in a}


def decides(f: Filter) -> bool:
    """Whether the filter speaks of a header column only."""
    if isinstance(f, Not):
        return decides(f.child)
    return isinstance(f, (In, IsNull, IsNotNull, *_COMPARE)) and f.attribute[0] in HEADERS and len(f.attribute) == 1


def holds(f: Filter, row: dict) -> bool | None:
    """SQL truth value of a filter."""
    if isinstance(f, Not):
        inner = holds(f.child, row)
        return None if inner is None else not inner
    value = row[f.attribute[0]]
    if isinstance(f, (IsNull, IsNotNull)):
        return (value is None) == isinstance(f, IsNull)
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return None
    if isinstance(f, In):
        return True if value in [v for v in f.value if v is not None] else None if None in f.value else False
    return None if f.value is None else _COMPARE[type(f)](value, f.value)


@dataclass
class WarcReader(DataSourceReader):
    path: str
    schema: StructType
    verify: bool
    filters: list[Filter] = field(default_factory=list)

    def pushFilters(self, filters):
        for f in filters:
            if decides(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Span]:
        fs, root = open_path(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [Span(self.path, 0, None)]
        manifest = f"{root}/{MANIFEST}"
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_file(manifest) as file:
                entries = json.loads(file.read())["files"]
            return [Span(f"{self.path}/{e['name']}", a, b) for e in entries for a, b in zip([0, *e["splits"]], [*e["splits"], e["size"]], strict=True) if b > a]
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        names = sorted(i.path[len(root):].lstrip("/") for i in found if i.type == pafs.FileType.File and i.path.endswith((".warc", ".warc.gz")))
        return [Span(f"{self.path}/{n}", 0, None) for n in names]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        names = self.schema.names
        if not isinstance(span, Span):  # an archive without files
            return
        fs, path = open_path(span.path)
        kinds = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in self.schema])
        rows: list[dict] = []
        held = 0
        with fs.open_input_file(path) as file:
            for r in records(file, span.start, span.stop):
                row = {c: r.fields.get(h.lower()) for c, h in HEADERS.items()}
                row["content_length"] = r.length
                if row["payload_digest"]:
                    row["payload_digest"] = row["payload_digest"].split(":", 1)[-1]
                if any(holds(f, row) is not True for f in self.filters):
                    r.block(0)
                    continue
                row |= self._payload(r, row, "payload" in names)
                rows.append({c: row[c] for c in names})
                held += 256 + len(row["payload"] or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    def _payload(self, r: PlainRecord | PackedRecord, row: dict, wanted: bool) -> dict:
        revisit = row["record_type"] == "revisit"
        whole = (wanted or self.verify) and not revisit
        block = r.block(None if whole else min(r.length, CHUNK))
        http, start = http_parts(block)
        stated = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        payload = block[start:] if whole else None
        out = {"payload": payload if wanted else None, "intact": None, "payload_bytes": stated if revisit else r.length - start}
        if self.verify and payload is not None:
            measured = digest_of(payload)
            told = (row["payload_digest"] or measured, len(payload) if stated is None else stated)
            out |= {"intact": told == (measured, len(payload)) if row["payload_digest"] else None, "payload_digest": measured, "payload_bytes": len(payload)}
        return out


# --- writing ---


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files under names of its own; the manifest of the commit says which ones count."""

    def __init__(self, path: str, packed: bool, date: str, overwrite: bool):
        self.path, self.packed, self.date, self.overwrite = path, packed, date, overwrite

    def write(self, iterator) -> Written:
        fs, root = open_path(self.path)
        files: list[dict] = []
        out = None
        try:
            for batch in iterator:
                columns = [batch.column(c.split()[0]) for c in RECORD.split(", ")]
                for values in zip(*columns, strict=True):
                    kind, record_id, uri, refers_to, payload = (v.as_py() for v in values)
                    data = record(kind, record_id, uri, refers_to, payload or b"", self.date)
                    data = member(data) if self.packed else data
                    if out is None or files[-1]["size"] >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        else:
                            fs.create_dir(root, recursive=True)
                        files.append({"name": f"{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}", "size": 0, "splits": []})
                        out = fs.open_output_stream(f"{root}/{files[-1]['name']}", compression=None)
                    own = files[-1]
                    if own["size"] - (own["splits"] or [0])[-1] >= SPLIT:
                        own["splits"].append(own["size"])
                    out.write(data)
                    own["size"] += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, root = open_path(self.path)
        fs.create_dir(root, recursive=True)
        manifest = f"{root}/{MANIFEST}"
        files = [f for m in messages if m for f in m.files]
        if not self.overwrite and fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_file(manifest) as file:
                files = json.loads(file.read())["files"] + files
        with fs.open_output_stream(manifest, compression=None) as file:
            file.write(json.dumps({"files": files}).encode())

    def abort(self, messages) -> None:
        fs, root = open_path(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{root}/{f['name']}")


class Warc(DataSource):
    """Options: ``path``; reading: ``verify`` (inflate payloads, measure digest and length, and say in ``intact`` whether they are the stated ones; null where no digest is stated); writing: ``compression``
    (``gzip`` or ``none``) and ``date`` (the WARC-Date of all records)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, self.options.get("verify", "false").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("compression", "gzip") == "gzip", self.options.get("date", "1970-01-01T00:00:00Z"), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


# --- pages ---


def page_records(pages: DataFrame, id_column: str = "page_id", uri_column: str = "url", text_column: str = "html") -> DataFrame:
    """Rows of ``RECORD``, one per page."""
    rows = pages.select(F.col(id_column).alias("id"), F.col(uri_column).alias("uri"), F.coalesce(text_column, F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = write_once(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")), "warc-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    several = groups.filter("n > 1").select("digest", "first", (F.col("n") * HOT >= total).alias("hot"))
    hot = several.filter("hot").select("digest", F.col("first").alias("hot_first"))  # at most HOT rows
    # Rows of hot groups need no partner any more; a key of their own keeps them spread.
    rows = rows.join(F.broadcast(hot), "digest", "left").withColumn("key", F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.col("id").cast("string"))))
    rows = rows.join(several.filter("not hot").select(F.col("digest").alias("key"), "first"), "key", "left").withColumn("first", F.coalesce("hot_first", "first"))
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = F.coalesce(F.col("first") != F.col("id"), F.col("first").isNotNull())
    return rows.select(F.when(again, "revisit").otherwise("response").alias("record_type"), named(F.col("id")).alias("record_id"), F.col("uri").cast("string").alias("target_uri"),
                       F.when(again, named(F.col("first"))).alias("refers_to"), "payload")


def write_pages(pages: DataFrame, path: str, id_column: str = "page_id", uri_column: str = "url", text_column: str = "html", compression: str = "gzip") -> None:
    register(pages.sparkSession)
    page_records(pages, id_column, uri_column, text_column).write.format("warc").option("compression", compression).mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = False, verify: bool = False) -> DataFrame:
    """Records with their headers; with ``payload`` the payload too (null for revisits)."""
    register(spark)
    columns = SCHEMA if payload else SCHEMA.rsplit(",", 1)[0]
    return spark.read.format("warc").schema(columns).option("verify", str(verify).lower()).load(path)


def page_id(column: str, kind: str = "long"):
    """Page id in a record id of ``write_pages``; null if it has none."""
    return F.nullif(F.regexp_extract(column, r"^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
