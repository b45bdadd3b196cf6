"""Token ids of a corpus in bit-packed files.

Every id takes the fewest bits that hold the vocabulary. Documents are written
in ascending id order: a range partitioning deals them to tasks, each task
encodes its texts in order and writes files of its own. A manifest lists the
files of the attempts that committed, in order, with their numbers of ids, so
the global place of every id is known without reading a file.

File layout, all numbers little-endian::

    magic
    blocks        block_ids ids each (the last: fewer), packed from the lowest bit on;
                  64 ids are exactly ``width`` 64-bit words, the last ones padded with zeros
    doc ids       int64 each, then one byte each: 1 if the id is not null
    doc starts    uint64 each, one more than documents: place of the first id in this file
    block offsets uint64 each, one more than blocks: byte position in this file
    block CRCs    uint32 each
    footer        width, block_ids (uint32); ids, documents, blocks, position of the doc ids (uint64);
                  CRC of all from the doc ids to here (uint32); magic

Unpacking takes 64 ids as a column each: 64 vector operations a block, at any
width. Any run of ids is read from the blocks it lies in, found by the block
offsets; a document by binary search in the doc ids. The reader has a partition
per file, skips files without any of the documents asked for, and unpacks about
``READ_IDS`` ids at a time.

Ids come from the vocabulary in the named ``tokenizers`` file (see
``packing.encoder``).

Edge cases: a null or empty text is its end id alone; null document ids come
first; rows that repeat an id are ordered by their text's hash and stay rows of
their own; an id or a repeated row may hold any share of the table, equal rows
are dealt to several tasks; a very long text spans blocks and is one row when
read; an empty table gives a manifest without files, which reads back empty;
other columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from graphsift.llm.common import filesystem, map_texts
from graphsift.llm.packing import encoder

MAGIC = b"TOKBITS1"
FOOTER = "<IIQQQQI8s"
FOOTER_BYTES = struct.calcsize(FOOTER)
BLOCK_IDS = 1 << 14
READ_IDS = 1 << 20
MANIFEST = "manifest.json"
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


# ---- bits ----

def bit_width(max_id: int) -> int:
    """Fewest bits that hold every id up to ``max_id``."""
    return max(1, int(max_id).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """``ids`` at ``width`` bits each, padded with zeros to a multiple of 64 ids."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} needs more than {width} bits")
    columns = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    columns.reshape(-1)[:len(ids)] = ids
    words = np.zeros((len(columns), width), "<u8")
    for c in range(64):
        word, shift = divmod(c * width, 64)
        words[:, word] |= columns[:, c] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= columns[:, c] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack_bits(data: bytes, width: int, count: int) -> np.ndarray:
    """The first ``count`` ids (uint32) of :func:`pack_bits`."""
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for c in range(64):
        word, shift = divmod(c * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, c] = value & mask
    return out.reshape(-1)[:count]


# ---- files ----

class FileWriter:
    """One file: ids are packed block by block as documents arrive."""

    def __init__(self, stream, width: int, block_ids: int = BLOCK_IDS):
        if block_ids % 64:
            raise ValueError("block_ids must be a multiple of 64")
        self.stream, self.width, self.block_ids = stream, width, block_ids
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.doc_ids: list[int | None] = []
        self.starts, self.offsets, self.crcs = [0], [len(MAGIC)], []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block_ids:
            joined = np.concatenate(self.waiting)
            whole = len(joined) // self.block_ids * self.block_ids
            for at in range(0, whole, self.block_ids):
                self._block(joined[at:at + self.block_ids])
            self.waiting, self.n_waiting = [joined[whole:]], len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.width)
        self.stream.write(data)
        self.crcs.append(zlib.crc32(data))
        self.offsets.append(self.offsets[-1] + len(data))

    @property
    def size(self) -> int:
        return self.offsets[-1]

    def close(self) -> dict:
        """Write what is left and the index; what the manifest says of the file."""
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        known = [i for i in self.doc_ids if i is not None]
        index = b"".join([np.array([i or 0 for i in self.doc_ids], "<i8").tobytes(),
                          np.array([i is not None for i in self.doc_ids], np.uint8).tobytes(),
                          np.array(self.starts, "<u8").tobytes(), np.array(self.offsets, "<u8").tobytes(),
                          np.array(self.crcs, "<u4").tobytes()])
        head = struct.pack(FOOTER, self.width, self.block_ids, self.n_ids, len(self.doc_ids), len(self.crcs), self.size, 0, b"")
        crc = zlib.crc32(head[:-12], zlib.crc32(index))
        self.stream.write(index + head[:-12] + struct.pack("<I", crc) + MAGIC)
        self.stream.close()
        return {"ids": self.n_ids, "docs": len(self.doc_ids), "nulls": len(known) < len(self.doc_ids),
                "first": min(known, default=None), "last": max(known, default=None)}


class TokenFile:
    """Random access to one file, given as a seekable stream."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size() if callable(getattr(stream, "size", None)) else stream.seek(0, 2)
        foot = self._at(size - FOOTER_BYTES, FOOTER_BYTES)
        (self.width, self.block_ids, self.n_ids, self.n_docs, n_blocks, index_at, crc, magic) = struct.unpack(FOOTER, foot)
        index = self._at(index_at, size - FOOTER_BYTES - index_at)
        if magic != MAGIC or crc != zlib.crc32(foot[:-12], zlib.crc32(index)):
            raise ValueError("not a token file, or damaged")
        ends = np.cumsum([8 * self.n_docs, self.n_docs, 8 * (self.n_docs + 1), 8 * (n_blocks + 1), 4 * n_blocks])
        parts = [index[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        self.doc_ids, self.known = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], np.uint8) == 1
        self.starts, self.offsets = (np.frombuffer(x, "<u8").astype(np.int64) for x in parts[2:4])
        self.crcs = np.frombuffer(parts[4], "<u4")

    def _at(self, position: int, length: int) -> bytes:
        self.stream.seek(position)
        return self.stream.read(length)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids at places start .. stop - 1 of this file, from the blocks they lie in."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError(f"{start}:{stop} of {self.n_ids} ids")
        if start == stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        data = self._at(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        for b in range(first, last + 1):
            a = int(self.offsets[b] - self.offsets[first])
            if zlib.crc32(data[a:a + int(self.offsets[b + 1] - self.offsets[b])]) != self.crcs[b]:
                raise ValueError(f"block {b} is damaged")
        whole = unpack_bits(data, self.width, stop - first * self.block_ids)   # only the last block of a file is padded
        return whole[start - first * self.block_ids:]

    def rows_of(self, doc_ids: list[int]) -> np.ndarray:
        """Rows of the documents with these ids; null ids come first, the others ascend."""
        nulls = int(np.argmax(self.known)) if self.known.any() else self.n_docs
        wanted, ascending = np.unique(np.array(doc_ids, np.int64)), self.doc_ids[nulls:]
        lo, hi = np.searchsorted(ascending, wanted, "left"), np.searchsorted(ascending, wanted, "right")
        return nulls + np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)


# ---- data source ----

class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options["width"])
        self.roll, self.block_ids = int(options.get("roll_bytes", 128 << 20)), int(options.get("block_ids", BLOCK_IDS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        done, out = [], None
        for batch in iterator:
            for doc_id, ids in zip(batch.column(0), batch.column(1), strict=True):
                if out is None:
                    name = f"part-{task:06d}-{len(done):04d}-{attempt}.tok"
                    out = FileWriter(files.open_output_stream(f"{root}/{name}", compression=None), self.width, self.block_ids)
                out.add(doc_id.as_py(), np.frombuffer(ids.as_buffer(), "<u4"))
                if out.size >= self.roll:
                    done.append({"name": name, "task": task, **out.close()})
                    out = None
        if out:
            done.append({"name": name, "task": task, **out.close()})
        message = WriterCommitMessage()
        message.files = done
        return message

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        parts = [m.files for m in messages if m and m.files]
        ordered = [f for part in sorted(parts, key=lambda p: p[0]["task"]) for f in part]
        with files.open_output_stream(f"{root}/{MANIFEST}") as stream:
            stream.write(json.dumps({"width": self.width, "files": ordered}).encode())

    def abort(self, messages) -> None:
        """Files of an aborted job are in no manifest, so nothing reads them."""


class TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.only = json.loads(options["doc_ids"]) if "doc_ids" in options else None
        self.with_ids = options.get("ids", "true") == "true"

    def partitions(self):
        files, root = filesystem(self.path)
        with files.open_input_stream(f"{root}/{MANIFEST}") as stream:
            listed = json.loads(stream.read())["files"]
        out, base = [], 0
        for f in listed:
            if self.only is None or f["first"] is not None and any(f["first"] <= i <= f["last"] for i in self.only):
                out.append(InputPartition((f"{self.path}/{f['name']}", base)))
            base += f["ids"]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, base = partition.value
        files, where = filesystem(path)
        with files.open_input_file(where) as stream:
            file = TokenFile(stream)
            rows = np.arange(file.n_docs) if self.only is None else file.rows_of(self.only)
            for run in _runs(rows, file.starts):
                yield self._batch(file, run, base)

    def _batch(self, file: TokenFile, run: np.ndarray, base: int) -> pa.RecordBatch:
        starts, stops = file.starts[run], file.starts[run + 1]
        ids: list[bytes | None] = [None] * len(run)
        if self.with_ids:
            raw = memoryview(file.ids(int(starts[0]), int(stops[-1])).astype("<u4").tobytes())
            ids = [bytes(raw[4 * (a - starts[0]):4 * (b - starts[0])]) for a, b in zip(starts, stops, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(file.doc_ids[run], pa.int64(), mask=~file.known[run]), pa.array(starts + base), pa.array(stops - starts),
             pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def _runs(rows: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Consecutive rows together, up to about READ_IDS ids."""
    at = 0
    while at < len(rows):
        stop = at + 1
        while stop < len(rows) and rows[stop] == rows[stop - 1] + 1 and starts[rows[stop] + 1] - starts[rows[at]] <= READ_IDS:
            stop += 1
        yield rows[at:stop]
        at = stop


class TokenSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_bits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenReader:
        return TokenReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(dict(self.options))


# ---- jobs ----

def max_id(vocabulary: str) -> int:
    """Largest id of a ``tokenizers`` file, special tokens included."""
    spec = json.load(open(vocabulary, encoding="utf-8"))
    return max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]]])


def encode(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): a row per document in the order of ``docs``; ids and end
    id as little-endian unsigned 32-bit numbers."""
    loaded = []  # once a task

    def ids(text: str | None) -> bytes:
        if not loaded:
            loaded.append(encoder(vocabulary))
        return np.append(loaded[0](text or ""), np.uint32(end_id)).astype("<u4").tobytes()

    out = map_texts(docs, id_col, text_col, lambda texts: [(ids(t),) for t in texts], "ids binary", 256)
    return out.select(F.col(id_col).cast("bigint").alias("doc_id"), "ids")


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Range partitions of (id, text), sorted: ids ascend from task to task and
    inside each; what repeats an id is ordered by the text's hash."""
    keyed = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("by_text"),
                        F.monotonically_increasing_id().alias("by_row"))
    order = [F.col(id_col).asc(), "by_text", "by_row"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(id_col, text_col)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
          block_ids: int = BLOCK_IDS, roll_bytes: int = 128 << 20) -> None:
    """Encode ``docs`` and write the files and the manifest below ``path``."""
    docs.sparkSession.dataSource.register(TokenSource)
    tokens = encode(in_order(docs, id_col, text_col), vocabulary, end_id, id_col, text_col)
    (tokens.write.format("token_bits").option("width", str(bit_width(max(max_id(vocabulary), end_id))))
     .option("block_ids", str(block_ids)).option("roll_bytes", str(roll_bytes)).mode("append").save(path))


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents below ``path``, or of
    ``doc_ids`` alone; without ``ids`` only the indexes are read."""
    spark.dataSource.register(TokenSource)
    reader = spark.read.format("token_bits").option("ids", str(ids).lower())
    if doc_ids is not None:
        reader = reader.option("doc_ids", json.dumps([int(i) for i in doc_ids]))
    return reader.load(path)
