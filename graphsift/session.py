"""Session helpers: building a local session for tests/bench and lineage cuts.

On a cluster the session comes from the caller; nothing here overrides
settings that are already present.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "graphsift") -> SparkSession:
    """Local session with the settings the library is tuned for.

    Only used by tests, bench and examples; library functions never create a
    session themselves.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder
        .master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a plain local session without
    one (tests, bench) gets a scratch folder of its own; anywhere else a
    missing setting is an error, because executors would write to disks
    that nobody else can read.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="graphsift-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new, unused path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/graphsift-{kind}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cut lineage by writing a parquet table into the shared checkpoint folder.

    Unlike ``checkpoint(eager=True)``, which computes the data twice (once for
    the action, once more to write the checkpoint files), this computes it
    once; the table is durable, so a lost executor never forces recomputing
    what came before it. ``compression`` as in Spark's parquet files (large
    tables of text take less room as ``zstd``).
    """
    spark = df.sparkSession
    path = shared_path(spark, "tables")
    df.write.mode("overwrite").parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)  # known schema: no footer inference
    out._graphsift_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`cut_lineage`, once
    nothing reads it any more. Other DataFrames are left alone."""
    path = getattr(df, "_graphsift_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
