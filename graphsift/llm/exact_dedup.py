"""Exact deduplication as a stateful stream with disk-backed keyed state.

The table is read as a stream (``availableNow``); the keyed state, held in
RocksDB and checkpointed in the shared folder, keeps per SHA-256 digest the
keeper's stable identifier (the largest id), its content locator (file and row
of the keeper) and the number of rows seen. There is no watermark, so nothing
ever expires, and a later run on the same checkpoint continues the state.

The digest alone decides nothing: for every digest that was hit, the full
bytes of all its texts are compared (smallest against largest, combined per
task before the shuffle, so a hot group sends one text per task). Should a
digest ever hold different texts, those rows are grouped by their whole text
instead.

Only DataFrame and SQL functions run on the data; no Python on executors.

Edge cases: a null text equals the empty text; repeated rows (same id, same
text) are separate rows of which the locator picks one keeper; null ids rank
below every id; an empty table gives an empty result; extra columns are
carried (``exact_dedup``) inside one struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsift.llm.common import lookup, whole_row
from graphsift.session import cut_lineage, shared_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, row_id, content, digest, file, pos) of a parquet-backed frame."""
    content = F.coalesce(F.col(text_col), F.lit(""))
    at = df.metadataColumn("_metadata")       # also where the table has a column of this name
    return df.select(whole_row(df).alias("row"), F.col(id_col).alias("row_id"), content.alias("content"),
                     F.unhex(F.sha2(content, 256)).alias("digest"),
                     at["file_path"].alias("file"), at["row_index"].alias("pos"))


def _as_glob(path: str) -> str:
    """A pattern that matches ``path`` alone: the stream source takes a plain
    path to be a folder, while a table may be one file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def update_state(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str,
                 id_col: str = "doc_id", text_col: str = "text", max_bytes_per_trigger: int = 256 << 30,
                 state_memory_mb: int = 64) -> DataFrame:
    """Run the stream over all files of ``path`` not seen by ``checkpoint`` yet
    and return the state: (digest, group_size, keeper(row_id, file, pos)).

    ``state_memory_mb`` bounds the memory that RocksDB takes in each executor,
    whatever the number of state partitions; the rest of the state is on disk.
    """
    own = spark.newSession()  # its settings don't touch the caller's session
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", str(state_memory_mb))
    # Without this every state partition reserves megabytes for files that stay small.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    source = (own.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes_per_trigger))
              .parquet(_as_glob(path)))
    keeper = F.struct("row_id", "file", "pos")
    groups = (_rows(source, id_col, text_col).groupBy("digest")
              .agg(F.count("*").alias("group_size"), F.max(keeper).alias("keeper")))
    query = (groups.writeStream.outputMode("update").format("noop")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.digest", *[F.col(f"value.{f.name}").alias(n) for f, n in
                                        zip(state.schema["value"].dataType.fields,
                                            ("group_size", "keeper"), strict=False)])


def dedup_table(spark: SparkSession, path: str, schema: T.StructType, id_col: str = "doc_id",
                text_col: str = "text", checkpoint: str | None = None) -> DataFrame:
    """(row, row_id, keep_id, group_size, kept, digest) for every row of the
    parquet table at ``path``; ``row`` is a struct of the table's own columns.

    With ``checkpoint`` a later call after new files arrived goes on from the
    retained state.
    """
    state = update_state(spark, path, schema, checkpoint or shared_path(spark, "dedup-state"), id_col, text_col)
    hits = lookup(state.where("group_size > 1")
                  .select(F.col("digest").alias("hit"), F.col("group_size").alias("size"), "keeper"))
    rows = _rows(spark.read.schema(schema).parquet(path), id_col, text_col)
    members = rows.join(hits, F.col("digest") == F.col("hit"), "left")

    # Full bytes on hits: different texts below one digest, of which none is expected.
    contested = cut_lineage(
        rows.join(hits, F.col("digest") == F.col("hit"), "left_semi").groupBy("digest")
        .agg(F.min("content").alias("lo"), F.max("content").alias("hi"))
        .where(F.col("lo") != F.col("hi")).select(F.col("digest").alias("contested")))
    if not contested.isEmpty():
        members = _by_whole_text(rows, members, contested)

    own = F.struct("row_id", "file", "pos")
    return members.select(
        "row", "row_id", F.when(F.col("hit").isNull(), F.col("row_id")).otherwise(F.col("keeper.row_id"))
        .alias("keep_id"), F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("hit").isNull() | own.eqNullSafe(F.col("keeper"))).alias("kept"), "digest")


def _by_whole_text(rows: DataFrame, members: DataFrame, contested: DataFrame) -> DataFrame:
    """``members`` with the rows of contested digests grouped by their text."""
    clash = rows.join(contested, F.col("digest") == F.col("contested"), "left_semi")
    groups = (clash.groupBy(F.col("content").alias("same"))
              .agg(F.count("*").alias("size"), F.max(F.struct("row_id", "file", "pos")).alias("keeper")))
    regrouped = (clash.join(groups, F.col("content") == F.col("same"))
                 .select(*rows.columns, F.col("digest").alias("hit"), "size", "keeper"))
    return (members.join(contested, F.col("digest") == F.col("contested"), "left_anti")
            .unionByName(regrouped))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`dedup_table` for any DataFrame, landed first as the table that
    the stream reads."""
    spark = docs.sparkSession
    path = shared_path(spark, "dedup-landing")
    docs.write.parquet(path)
    return dedup_table(spark, path, docs.schema, id_col, text_col)
