"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsift.operators.joins import broadcast_if_small
from graphsift.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only the named columns, so that extra columns can never clash."""
    return df.select(F.col(id_col), *[F.col(c) for c in cols])


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, whatever they are named."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def lookup(df: DataFrame) -> DataFrame:
    """The lookup side of a join, cut and measured: broadcast up to
    ``BROADCAST_MAX_BYTES``; beyond that a shuffle join, whose hot keys adaptive
    execution splits. The rows are the same either way."""
    return broadcast_if_small(cut_lineage(df))


def by_value(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives ``value`` back inside tasks, broadcast once.

    Spark pickles broadcast objects by reference to their classes, which the
    workers of a cluster without this package cannot import; here the classes
    travel with the object. It is unpickled once a task.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list = []

    def get() -> object:
        if not held:
            held.append(pickle.loads(sent.value))
        return held[0]

    return get


def spanning_forest(max_held: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over pairs (a, b): edges (a, b) that connect what the
    task's pairs connect, fewer than it has vertices. Dense groups of pairs
    shrink to a tree before anything is shuffled; at most about ``max_held``
    vertices are held at once."""
    def edges(parent: dict[int, int]) -> pa.RecordBatch:
        rest = [(v, p) for v, p in parent.items() if v != p]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rest], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            while (up := parent.setdefault(v, v)) != v:
                parent[v] = v = parent[up]
            return v

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > max_held:
                yield edges(parent)
                parent.clear()
        yield edges(parent)

    return run


def map_texts(df: DataFrame, id_col: str, text_col: str, fn: Callable[[list], list],
              out: str, sub_batch: int = 512, keep: list[str] | None = None) -> DataFrame:
    """(id, *keep, *out): ``fn`` takes up to ``sub_batch`` texts (None for null) and
    returns one tuple per text.

    ``out`` is a DDL list of the result columns. Batches are cut small so a
    Python worker never holds the feature rows of a whole Arrow batch.
    """
    fields = T.StructType.fromDDL(out).fields if isinstance(out, str) else list(out)
    carried = [id_col, *(keep or [])]
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in carried], *fields])
    arrow = [to_arrow(f.dataType) for f in fields]
    names = [*carried, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, sub_batch):
            rows = fn(part.column(len(carried)).to_pylist())
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:len(carried)], *[pa.array(list(c), type=t) for c, t in zip(cols, arrow, strict=True)]],
                names=names)

    return id_and(df, *carried, text_col).mapInArrow(run, schema)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that only so many
    texts are Python objects at once."""
    release_memory()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        del batch
    release_memory()


def release_memory() -> None:
    """Hand freed memory back to the system. Spark uses a Python worker again
    for later jobs, which would otherwise pile up what each left unused."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc has it
    if trim:
        trim(0)


def to_arrow(kind: T.DataType) -> pa.DataType:
    """Arrow type of the few Spark types the operators return."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(),
            T.FloatType: pa.float32(), T.StringType: pa.string(), T.BooleanType: pa.bool_(),
            T.BinaryType: pa.binary()}[type(kind)]


def filesystem(path: str):
    """(pyarrow file system, path in it) of any URI or plain path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
