"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest lookup side that is broadcast, in bytes of its rows as text.
BROADCAST_MAX_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only after measuring the rows; above the bound the join
    stays a shuffle join (adaptive execution may still broadcast, and splits
    hot keys).

    Meant for pattern-, type- and vocabulary-level tables that are already
    cut into a table, so measuring them is a cheap scan of it.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df
