"""Dense numbering of whole tables without a window over all rows.

Rows are range-partitioned by their order and sorted inside their partition;
counts per partition and a prefix sum over them give every row its place. The
only windows run over one row per partition (and group). A group, a key or a
repeated row may hold any share of the table: the last order column is the
row's own number in the input, so equal rows are dealt to several partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphsift.operators.joins import broadcast_if_small
from graphsift.session import cut_lineage

_AT_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def dense_number(df: DataFrame, order: list[str | Column], group: str | None = None, pos: str = "pos",
                 size: str | None = None) -> DataFrame:
    """``df`` with ``pos`` (0, 1, ... in ``order`` inside each ``group``, or over
    the whole table) and, if named, the group's ``size``. Without any ``order``
    rows are numbered where they lie and nothing is shuffled.

    Nulls come first in ascending order and a null group is a group. Rows equal
    in ``order`` are numbered in any order. The result reads a table that is
    written once, so numbers don't change when tasks run again.
    """
    group = group or "_g"
    keyed = df if group in df.columns else df.withColumn(group, F.lit(0))
    keyed = keyed.withColumn("_tie", F.monotonically_increasing_id())
    cols = [F.col(group).asc(), *[F.col(c) if isinstance(c, str) else c for c in order], F.col("_tie")]
    if order:
        keyed = keyed.repartitionByRange(*cols)
    dealt = (keyed.sortWithinPartitions(*cols)
             .withColumn("_part", F.spark_partition_id())
             .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _AT_BITS) - 1))))
    kept = cut_lineage(dealt.drop("_tie"), "zstd")
    runs = kept.groupBy(group, "_part").agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col(group).alias("_rg"), F.col("_part").alias("_rp"),
                       (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_shift"),
                       F.sum("n").over(Window.partitionBy(group)).alias("_size"))
    runs = broadcast_if_small(cut_lineage(runs))
    out = kept.join(runs, F.col(group).eqNullSafe(F.col("_rg")) & (F.col("_part") == F.col("_rp")))
    extra = [] if size is None else [F.col("_size").alias(size)]
    return out.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns],
                      (F.col("_at") + F.col("_shift")).alias(pos), *extra)
