"""Pattern encoding: which properties each element carries (ENC1, ENC4-6).

Everything downstream of this module runs on *distinct patterns* with a
weight ``n``: equal (labels, property set) implies equal features, equal
hashes and equal cluster, so the per-element work is one aggregation with
map-side partial counts.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsift.functions.text import joined, label_key


def prop_keys(props: str | Column = "props", drop_null_values: bool = False) -> Column:
    """Sorted keys of the non-null entries of a property map (ENC5).

    Canonical tables (``read_nodes``/``read_edges``) never store null values,
    so by default the keys are taken as they are, with codegen'd
    ``sort_array``; pass ``drop_null_values`` for maps from elsewhere.
    """
    m = F.col(props) if isinstance(props, str) else props
    if drop_null_values:
        m = F.map_filter(m, lambda k, v: v.isNotNull())
    return F.sort_array(F.map_keys(m))


def property_names(df: DataFrame) -> DataFrame:
    """ENC4: distinct property names of a canonical table (one row each)."""
    return (df.select(F.explode(prop_keys("props")).alias("property"))
            .distinct())


def presence_flags(df: DataFrame, props: Sequence[str] | None = None) -> DataFrame:
    """ENC1: one 0.0/1.0 column per property (``prop_<name>``).

    Without ``props`` the columns are all property names of ``df`` (one name
    per column of the result, found by a distributed distinct)."""
    keys = prop_keys("props")
    if props is None:
        props = [r[0] for r in property_names(df).orderBy("property").collect()]
    return df.select("*", *[F.array_contains(keys, p).cast("double").alias(f"prop_{p}")
                            for p in props])


def with_node_key(nodes: DataFrame) -> DataFrame:
    """Add the node pattern key columns (labels_key, prop_keys)."""
    return nodes.withColumn("labels_key", label_key("labels")).withColumn("prop_keys", prop_keys())


def with_edge_key(edges: DataFrame) -> DataFrame:
    """Add the edge pattern key columns (rel_type, src_key, dst_key, prop_keys)."""
    return (edges.withColumn("src_key", label_key("src_labels"))
            .withColumn("dst_key", label_key("dst_labels"))
            .withColumn("prop_keys", prop_keys()))


NODE_KEY = ["labels_key", "prop_keys"]
EDGE_KEY = ["rel_type", "src_key", "dst_key", "prop_keys"]


def node_patterns(nodes: DataFrame) -> DataFrame:
    """ENC6: distinct node patterns with their element count ``n``.

    One shuffle of (key, partial count) rows; a pattern holding a third of all
    nodes is pre-aggregated on the map side, so no task sees its rows. Elements
    are counted by their labels and names as they are; keys are made per distinct one.
    """
    met = nodes.groupBy("labels", F.map_keys("props").alias("names")).agg(F.count(F.lit(1)).alias("n"))
    return (met.select(label_key("labels").alias("labels_key"), F.sort_array("names").alias("prop_keys"), "n")
            .groupBy(*NODE_KEY).agg(F.sum("n").alias("n")))


def edge_patterns(edges: DataFrame) -> DataFrame:
    """ENC6 for edges: distinct (rel_type, src label set, dst label set, props)."""
    met = (edges.groupBy("rel_type", "src_labels", "dst_labels", F.map_keys("props").alias("names"))
           .agg(F.count(F.lit(1)).alias("n")))
    return (met.select("rel_type", label_key("src_labels").alias("src_key"), label_key("dst_labels").alias("dst_key"),
                       F.sort_array("names").alias("prop_keys"), "n")
            .groupBy(*EDGE_KEY).agg(F.sum("n").alias("n")))


def exact_node_clusters(patterns: DataFrame) -> DataFrame:
    """CLU6: one cluster per distinct pattern; readable deterministic id."""
    return patterns.withColumn(
        "cluster_id", F.concat_ws("#", "labels_key", joined(F.col("prop_keys"), ",")))


def exact_edge_clusters(patterns: DataFrame) -> DataFrame:
    return patterns.withColumn(
        "cluster_id", F.concat_ws("#", "rel_type", "src_key", "dst_key",
                                  joined(F.col("prop_keys"), ",")))
