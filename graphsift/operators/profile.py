"""One pass over element data for both pattern counts and value typing.

Each element contributes one marker entry (its pattern key) and one entry
per property; a single grouped aggregation with map-side partials yields
pattern counts (marker groups) and the per-property type tests (property
groups). Discovery therefore scans nodes once and edges twice (here, and for
degree statistics) instead of once per statistic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsift.functions import typing as ty
from graphsift.operators import infer
from graphsift.operators.patterns import EDGE_KEY, NODE_KEY, edge_patterns, with_edge_key, with_node_key

_MARK = "\u0001"


def element_profile(keyed: DataFrame, key_cols: list[str], date_mode: str = "lenient") -> DataFrame:
    """Aggregate (key_cols..., property, n, all_* flags, n_values); pattern rows
    have ``property`` null, property rows have the key columns null."""
    marker = F.create_map(F.lit(_MARK), F.lit(None).cast("string"))
    rows = keyed.select(*key_cols, F.explode(F.map_concat(marker, F.col("props"))).alias("_k", "_v"))
    is_m = F.col("_k") == F.lit(_MARK)
    rows = rows.select(*[F.when(is_m, F.col(c)).alias(c) for c in key_cols], F.when(~is_m, F.col("_k")).alias("property"),
                       F.when(~is_m, F.col("_v")).alias("_v"), is_m.cast("bigint").alias("_m"))
    return ty.tested(rows, "_v", date_mode, [*key_cols, "property"], F.sum("_m").alias("n"))


def value_profile(elements: DataFrame, date_mode: str = "lenient") -> DataFrame:
    """The property rows of :func:`element_profile` alone, without keys: nothing
    but names and values is looked at."""
    rows = elements.select(F.explode("props").alias("property", "_v"))
    return ty.tested(rows, "_v", date_mode, ["property"], F.lit(0).cast("bigint").alias("n"))


def node_profile(nodes: DataFrame, date_mode: str = "lenient") -> DataFrame:
    return element_profile(with_node_key(nodes.select("labels", "props")), NODE_KEY, date_mode)


def edge_profile(edges: DataFrame, date_mode: str = "lenient", raw_edges: DataFrame | None = None) -> DataFrame:
    """As for nodes; with ``raw_edges`` values are typed there, before any
    join, and of ``edges`` only property names and endpoint labels are used."""
    if raw_edges is None:
        return element_profile(with_edge_key(edges.select("rel_type", "src_labels", "dst_labels", "props")),
                               EDGE_KEY, date_mode)
    none = [F.lit(None).cast("array<string>" if c == "prop_keys" else "string").alias(c) for c in EDGE_KEY]
    typed = value_profile(raw_edges, date_mode)
    typed = typed.select(*none, *typed.columns)
    counted = edge_patterns(edges)
    empty = [F.lit(None).cast(typed.schema[c].dataType).alias(c) for c in typed.columns if c not in (*EDGE_KEY, "n")]
    return counted.select(*EDGE_KEY, *empty[:1], "n", *empty[1:]).unionByName(typed)


def patterns_of(profile: DataFrame, key_cols: list[str]) -> DataFrame:
    return profile.where(F.col("property").isNull()).select(*key_cols, "n")


def types_of(profile: DataFrame) -> DataFrame:
    t = (F.when(F.col("n_values") == 0, F.lit(ty.EMPTY_TYPE))
         .when((F.col("property") == ty.IP_PROPERTY) | F.col("all_ip"), F.lit("String"))
         .when(F.col("all_int"), F.lit("Integer"))
         .when(F.col("all_double"), F.lit("Double"))
         .when(F.col("all_date"), F.lit("Date"))
         .when(F.col("all_bool"), F.lit("Boolean"))
         .otherwise(F.lit("String")))
    return (profile.where(F.col("property").isNotNull()
                          & ~F.col("property").isin(infer.IGNORED_PROPERTIES))
            .select("property", t.alias("type"), "n_values"))
