"""Web archives (WARC 1.1) as a Spark data source.

Writing: one record per page, each a gzip member of its own. Pages with equal
payloads of at least ``min_revisit_bytes`` share one ``response`` record, that
of the largest id; the others are ``revisit`` records that refer to it. Equality
is decided by SHA-256 and length with a two-level aggregation, so a payload
that a third of all pages share is one combined row per task. Tasks write
files of about ``roll_bytes`` under names of their own attempt; the driver
lists the committed ones in a manifest at the end, so a lost executor or a
second attempt leaves nothing that is read.

Reading: one partition per file: those of the manifest or, in a folder that has
none, all ``.warc`` and ``.warc.gz`` files of other writers, whose records may
share a gzip member or not be compressed at all. Filters on ``warc_type``, ``target_uri`` and
``page_id`` are pushed into the reader (with the session setting
``spark.sql.python.filterPushdown.enabled``; the options ``types`` and
``payload`` work without it). A record's header is parsed first, from the first
bytes of its member; a record that a filter rejects, or a payload that is not
asked for, is skipped by the member's length, which the writer leaves in the
gzip header's extra field. Members of other writers are inflated to their end,
in pieces; the whole block of their records is the payload.

Edge cases: a null or empty html is an empty payload; null ids rank below all
others and are written without an id; among rows that repeat both id and
payload, the last in table order is the response; without rows one manifest
without files is written and reads back as an empty table; extra columns of
the pages are not read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
                                    IsNotNull, StringStartsWith, WriterCommitMessage)

from graphsift.llm.common import filesystem, lookup

SCHEMA = """warc_type string, page_id bigint, record_id string, refers_to bigint, target_uri string,
    payload_bytes bigint, payload_digest string, payload binary"""
RECORD_SCHEMA = """page_id bigint, target_uri string, warc_type string, refers_to bigint, refers_to_uri string,
    payload_bytes bigint, sha1 binary, payload binary"""
HEAD = 1 << 13      # compressed bytes read to see a record's header
PIECE = 1 << 16     # bytes inflated at once
MAX_HEADER = 1 << 20
MANIFEST = "manifest.json"
FILE_NAME = "part-{:05d}-{}-{:04d}.warc.gz"
OWN_NAME = re.compile(r"part-\d{5,}-[0-9a-f]{8}-\d{4,}\.warc\.gz$")


# ---- records ----

def record_id(page_id: int | None, sha1: bytes) -> str:
    """Stable URN of a page's record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{sha1.hex()}')}>"


def gzip_member(data: bytes, level: int = 5) -> bytes:
    """One gzip member whose extra field 'LX' holds its whole length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    length = 24 + len(body) + 8
    extra = b"LX" + struct.pack("<HQ", 8, length)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def encode_record(row: dict, date: str) -> bytes:
    """A record of RECORD_SCHEMA as WARC text and payload."""
    sha1, payload = row["sha1"], row["payload"] or b""
    revisit = row["warc_type"] == "revisit"
    fields = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", record_id(row["page_id"], sha1)),
              ("WARC-Date", date), ("WARC-Target-URI", row["target_uri"]),
              ("WARC-Payload-Digest", "sha1:" + b32encode(sha1).decode()),
              ("WARC-Payload-Length", row["payload_bytes"]), ("WARC-Page-ID", row["page_id"])]
    block = b"" if revisit else payload
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_id(row["refers_to"], sha1)),
                   ("WARC-Refers-To-Target-URI", row["refers_to_uri"]),
                   ("WARC-Refers-To-Page-ID", row["refers_to"])]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(block))]
    head = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _one_line(value) -> str:
    """Header values hold no line breaks: they are percent-encoded."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def parse_header(head: bytes) -> dict[str, str]:
    """Lower-case field names to values; the first line is the version."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if colon:
            out[key.strip().lower()] = value.strip()
    return out


def _to_int(text: str | None) -> int | None:
    return None if text is None else int(text)


def header_row(fields: dict[str, str]) -> dict:
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    length = _to_int(fields.get("warc-payload-length", fields.get("content-length")))
    return {"warc_type": fields.get("warc-type"), "page_id": _to_int(fields.get("warc-page-id")),
            "record_id": fields.get("warc-record-id"), "refers_to": _to_int(fields.get("warc-refers-to-page-id")),
            "target_uri": fields.get("warc-target-uri"), "payload_bytes": length,
            "payload_digest": digest, "payload": None}


class _Member:
    """The inflated bytes of the gzip member at ``at``, in pieces."""

    def __init__(self, stream, at: int, head: bytes):
        self.stream, self.at, self.inflate = stream, at, zlib.decompressobj(31)
        self.raw, self.data = head, b""

    def more(self) -> bool:
        """Inflate up to PIECE further bytes; False at the member's end."""
        while not self.inflate.eof:
            raw = self.raw or self.stream.read(1 << 16)
            if not raw:
                raise ValueError(f"truncated gzip member at byte {self.at}")
            out = self.inflate.decompress(raw, PIECE)
            self.raw = self.inflate.unconsumed_tail
            if out:
                self.data += out
                return True
        return False

    def end(self) -> int:
        """Byte after the member; it must be read to its end."""
        while self.more():
            self.data = b""
        return self.stream.tell() - len(self.inflate.unused_data)


class _Plain(_Member):
    """The bytes of a file that is not compressed."""

    def __init__(self, stream, at: int, head: bytes):
        self.stream, self.at, self.data = stream, at, head

    def more(self) -> bool:
        data = self.stream.read(PIECE)
        self.data += data
        return bool(data)

    def end(self) -> int:
        while self.more():
            self.data = b""
        return self.stream.tell()


def _records(source: _Member, accept, with_payload: bool, only_one: bool) -> Iterator[dict]:
    """Rows of the records that follow each other in ``source``."""
    while True:
        while not source.data.lstrip(b"\r\n") and source.more():
            pass
        source.data = source.data.lstrip(b"\r\n")
        if not source.data:
            return
        while (end := source.data.find(b"\r\n\r\n")) < 0:
            if len(source.data) > MAX_HEADER or not source.more():
                raise ValueError(f"no end of a record's header after byte {source.at}")
        fields = parse_header(source.data[:end])
        row, left = header_row(fields), int(fields.get("content-length", 0))
        wanted = accept(row)
        if only_one and not (wanted and with_payload):
            if wanted:
                yield row
            return
        source.data = source.data[end + 4:]
        parts = []
        while left:
            if not source.data and not source.more():
                raise ValueError(f"truncated record after byte {source.at}")
            part, source.data = source.data[:left], source.data[left:]
            left -= len(part)
            if wanted and with_payload:
                parts.append(part)
        if wanted:
            row["payload"] = b"".join(parts) if with_payload else None
            yield row
        if only_one:
            return


def read_records(stream, accept, with_payload: bool) -> Iterator[dict]:
    """Rows of SCHEMA from a seekable stream: gzip members of one record each
    (this writer's), members of any number of records, or plain records.
    ``accept`` sees the header row; what it rejects is passed over, in members
    of this writer without inflating it."""
    at, size = 0, stream.size()
    while at < size:
        stream.seek(at)
        head = stream.read(min(HEAD, size - at))
        length = None
        if head[:2] == b"\x1f\x8b":
            if head[3] & 4 and head[12:14] == b"LX":
                length = struct.unpack_from("<Q", head, 16)[0]
            source = _Member(stream, at, head)
        elif head.lstrip(b"\r\n").startswith(b"WARC/"):
            source = _Plain(stream, at, head)
        else:
            raise ValueError(f"neither a gzip member nor a record at byte {at}")
        yield from _records(source, accept, with_payload, length is not None)
        at = source.end() if length is None else at + length


# ---- data source ----

def foreign_files(files, root: str) -> list[str]:
    """Archives below a folder without manifest. Files named as this writer's
    own are left out: without a manifest they belong to a write that did not end."""
    from pyarrow import fs

    found = [f.path[len(root):].lstrip("/") for f in files.get_file_info(fs.FileSelector(root, recursive=True))
             if f.type == fs.FileType.File]
    return sorted(n for n in found if n.endswith((".warc", ".warc.gz")) and not OWN_NAME.search(n))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path = options["path"]
        self.tests: list[tuple[str, str, object]] = []
        if options.get("types"):
            self.tests.append(("warc_type", "in", tuple(options["types"].split(","))))
        self.with_payload = str(options.get("payload", "true")).lower() != "false"
        self.columns = columns

    def take(self, filters) -> Iterator:
        """Take over filters on header fields; hand back all others."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) == 1 and column[0] in ("warc_type", "target_uri", "page_id"):
                if isinstance(f, EqualTo):
                    self.tests.append((column[0], "in", (f.value,)))
                    continue
                if isinstance(f, In):
                    self.tests.append((column[0], "in", tuple(f.value)))
                    continue
                if isinstance(f, StringStartsWith):
                    self.tests.append((column[0], "prefix", f.value))
                    continue
                if isinstance(f, IsNotNull):
                    self.tests.append((column[0], "known", None))
                    continue
            yield f

    def partitions(self):
        files, root = filesystem(self.path)
        try:
            with files.open_input_stream(f"{root}/{MANIFEST}") as stream:
                names = json.loads(stream.read())
        except FileNotFoundError:
            names = foreign_files(files, root)
        return [InputPartition(f"{self.path}/{n}") for n in names] or [InputPartition("")]

    def _accept(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            have = row[column]
            if have is None or kind == "in" and have not in value or kind == "prefix" and not have.startswith(value):
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        files, path = filesystem(partition.value)
        with files.open_input_file(path) as stream:
            for row in read_records(stream, self._accept, self.with_payload):
                yield tuple(row[c] for c in self.columns)


class PushedWarcReader(WarcReader):
    def pushFilters(self, filters):
        return self.take(filters)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.roll = options["path"], int(options.get("roll_bytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        names, out, size = [], None, 0
        for batch in iterator:
            for row in _rows_of(batch):
                if out is None or size >= self.roll:
                    if out:
                        out.close()
                    names.append(FILE_NAME.format(task, attempt, len(names)))
                    out, size = files.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                member = gzip_member(encode_record(row, date))
                out.write(member)
                size += len(member)
        if out:
            out.close()
        message = WriterCommitMessage()     # Spark's own class, known wherever it is unpickled
        message.names = names
        return message

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{MANIFEST}") as stream:
            stream.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages) -> None:
        """Files of an aborted job are in no manifest, so nothing reads them."""


def _rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for values in zip(*batch.columns, strict=True):
        yield dict(zip(names, (v.as_py() for v in values), strict=True))


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        options = dict(self.options)
        kind = PushedWarcReader if options.get("pushdown") == "true" else WarcReader
        return kind(options, [f.name for f in schema.fields])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


# ---- jobs ----

def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_revisit_bytes: int = 0) -> DataFrame:
    """Rows of RECORD_SCHEMA: which page is a response, which a revisit."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    base = (pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("target_uri"),
                         payload.alias("payload"), F.monotonically_increasing_id().alias("at"))
            .withColumn("payload_bytes", F.length("payload").cast("bigint"))
            .withColumn("sha256", F.unhex(F.sha2("payload", 256))))
    per_page = (base.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("sha256", "payload_bytes", "page_id")
                .agg(F.count("*").alias("n"), F.max(F.struct("at", "target_uri")).alias("last")))
    chosen = (per_page.groupBy("sha256", "payload_bytes")
              .agg(F.sum("n").alias("group_size"), F.max(F.struct("page_id", "n", "last")).alias("best"))
              .where("group_size > 1")
              .select(F.col("sha256").alias("k"), F.col("payload_bytes").alias("kb"), "best"))
    chosen = lookup(chosen)
    joined = base.join(chosen, (F.col("sha256") == F.col("k")) & (F.col("payload_bytes") == F.col("kb")), "left")
    same_id = F.col("page_id").eqNullSafe(F.col("best.page_id"))
    response = F.col("best").isNull() | same_id & ((F.col("best.n") == 1) | (F.col("at") == F.col("best.last.at")))
    return joined.select(
        "page_id", "target_uri", F.when(response, "response").otherwise("revisit").alias("warc_type"),
        F.when(~response, F.col("best.page_id")).alias("refers_to"),
        F.when(~response, F.col("best.last.target_uri")).alias("refers_to_uri"), "payload_bytes",
        F.unhex(F.sha1("payload")).alias("sha1"), _payload_unless(~response).alias("payload"))


def _payload_unless(revisit: Column) -> Column:
    return F.when(~revisit, F.col("payload"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          min_revisit_bytes: int = 0, roll_bytes: int = 64 << 20) -> None:
    """Write ``pages`` as WARC files and a manifest below ``path``."""
    pages.sparkSession.dataSource.register(WarcSource)
    (records(pages, id_col, url_col, html_col, min_revisit_bytes).write.format("warc")
     .option("roll_bytes", str(roll_bytes)).mode("append").save(path))


def read(spark: SparkSession, path: str, types: list[str] | None = None, payload: bool = True) -> DataFrame:
    """The records below ``path``; without ``payload`` that column is null and
    no payload is decoded."""
    spark.dataSource.register(WarcSource)
    reader = (spark.read.format("warc").option("payload", str(payload).lower())
              .option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")))
    if types:
        reader = reader.option("types", ",".join(types))
    return reader.load(path)
