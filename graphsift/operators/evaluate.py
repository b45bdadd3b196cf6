"""Clustering evaluation against known labels (EVA1-8).

Returns DataFrames (the reference only prints). Node-level work is a join
of elements to the small pattern -> type table plus a few aggregations;
the majority label per type is a partitioned window over (type, label)
counts, never over elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsift.functions.text import split_key
from graphsift.operators.joins import broadcast_if_small
from graphsift.operators.patterns import EDGE_KEY, NODE_KEY, with_edge_key, with_node_key
from graphsift.session import cut_lineage


def _require(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns for evaluation: {', '.join(missing)}")


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1)).otherwise(F.lit(0))


def assignments_nodes(nodes: DataFrame, node_pattern_types: DataFrame, node_types: DataFrame,
                      truth: DataFrame | Column) -> DataFrame:
    """EVA1/3/4: per node: type, predicted labels, actual labels, correctness flags.

    ``truth`` is either a DataFrame (node_id, true_labels ARRAY<STRING>),
    joined on node_id (nodes without truth get an empty list, as in the
    reference), or an ARRAY<STRING> Column computed from the node row itself
    (no join at all).
    """
    pt = node_pattern_types.select(*NODE_KEY, "type_id")
    pred = node_types.select("type_id", F.array_distinct(F.flatten(F.transform(
        "labels", split_key))).alias("predicted_labels"))
    base = nodes.select("node_id", "labels", "props")
    if isinstance(truth, Column):
        base = base.withColumn("true_labels", truth)
    else:
        _require(truth, ["node_id", "true_labels"])
    a = (with_node_key(base)
         .join(broadcast_if_small(pt), NODE_KEY)
         .join(broadcast_if_small(pred), "type_id"))
    if not isinstance(truth, Column):
        a = a.join(truth, "node_id", "left")
    a = a.select("node_id", "type_id", "predicted_labels",
                 F.coalesce("true_labels", F.array().cast("array<string>")).alias("actual_labels"))
    return (a.withColumn("correct_non_strict",
                         _flag(F.size(F.array_intersect("actual_labels", "predicted_labels")) > 0))
            .withColumn("correct_strict",
                        _flag(F.sort_array("actual_labels") == F.sort_array("predicted_labels"))))


def majority_labels(assign: DataFrame, actual: str = "actual_labels") -> DataFrame:
    """EVA5: most frequent actual label per type; ties -> smallest label."""
    freq = (assign.select("type_id", F.explode(actual).alias("label"))
            .groupBy("type_id", "label").agg(F.count(F.lit(1)).alias("freq")))
    w = Window.partitionBy("type_id").orderBy(F.col("freq").desc(), F.col("label"))
    return (freq.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select("type_id", F.col("label").alias("majority_label"), "freq"))


def evaluation_counts(assign: DataFrame, truth_key: Column, actual: str = "actual_labels") -> DataFrame:
    """(type_id, truth_key, actual, strict, non_strict, n): the only pass over
    the elements that evaluation needs, cut into a small table."""
    return cut_lineage(assign.groupBy(
        "type_id", truth_key.alias("truth_key"), F.col(actual).alias("actual"),
        F.col("correct_strict").alias("strict"), F.col("correct_non_strict").alias("non_strict"))
        .agg(F.count(F.lit(1)).alias("n")))


def clustering_metrics(assign: DataFrame, truth_key: Column, actual: str = "actual_labels") -> DataFrame:
    """EVA2-6: one row with TP, FP, FN, precision, recall, F1 (majority rule)
    and the numbers of strictly and loosely correct elements.

    TP/FP: members whose actual labels contain / miss their type's majority
    label. FN: per true label set, members beyond those correctly assigned.
    Elements without an actual label count for no type's majority.
    """
    counts = evaluation_counts(assign, truth_key, actual)
    freq = (counts.select("type_id", F.explode("actual").alias("label"), "n")
            .groupBy("type_id", "label").agg(F.sum("n").alias("freq")))
    best = freq.groupBy("type_id").agg(F.min(F.struct((-F.col("freq")).alias("f"), "label"))["label"].alias("majority"))
    scored = (counts.join(best, "type_id", "left")
              .withColumn("ok", F.when(F.array_contains("actual", F.col("majority")), F.col("n")).otherwise(F.lit(0)))
              .withColumn("in_scope", F.when(F.col("majority").isNotNull(), F.col("n")).otherwise(F.lit(0))))
    per_truth = scored.groupBy("truth_key").agg(
        F.sum("in_scope").alias("total"), F.sum("ok").alias("correct"),
        F.collect_set("type_id").alias("types"),
        F.sum(F.col("n") * F.col("strict")).alias("strict"),
        F.sum(F.col("n") * F.col("non_strict")).alias("non_strict"))
    m = per_truth.agg(
        F.sum("correct").alias("tp"), (F.sum("total") - F.sum("correct")).alias("fp"),
        F.sum(F.greatest(F.col("total") - F.col("correct"), F.lit(0))).alias("fn"),
        F.sum(F.when(F.col("total") > 0, 1).otherwise(0)).cast("bigint").alias("true_sets"),
        F.size(F.array_distinct(F.flatten(F.collect_list("types")))).cast("bigint").alias("predicted_types"),
        F.coalesce(F.sum("non_strict"), F.lit(0)).alias("non_strict_correct"),
        F.coalesce(F.sum("strict"), F.lit(0)).alias("strict_correct"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    m = m.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))) \
        .otherwise(0.0)
    return m.withColumn("f1", f1)


def assignments_edges(edges: DataFrame, edge_pattern_types: DataFrame, edge_types: DataFrame,
                      truth: DataFrame | dict[str, Column]) -> DataFrame:
    """EVA7: per edge (keyed by edge_id, so parallel edges stay apart).

    ``truth``: a DataFrame (edge_id, true_rel, true_src, true_dst), inner
    joined as in the reference, or a dict of those three ARRAY<STRING>
    Columns computed from the edge row (no join).
    """
    pt = edge_pattern_types.select(*EDGE_KEY, "type_id")
    pred = edge_types.select("type_id", F.col("rel_types").alias("p_rel"),
                             F.col("src_labels").alias("p_src"), F.col("dst_labels").alias("p_dst"))
    base = edges.select("edge_id", "rel_type", "src_id", "dst_id", "src_labels", "dst_labels", "props")
    if isinstance(truth, dict):
        base = base.select("*", *[c.alias(k) for k, c in truth.items()])
    else:
        _require(truth, ["edge_id", "true_rel", "true_src", "true_dst"])
    a = (with_edge_key(base)
         .join(broadcast_if_small(pt), EDGE_KEY).join(broadcast_if_small(pred), "type_id"))
    if not isinstance(truth, dict):
        a = a.join(truth, "edge_id", "inner")
    non_strict = ((F.size(F.array_except("true_rel", "p_rel")) == 0)
                  & (F.size(F.array_except("true_src", "p_src")) == 0)
                  & (F.size(F.array_except("true_dst", "p_dst")) == 0))
    strict = ((F.sort_array("true_rel") == F.sort_array("p_rel"))
              & (F.sort_array("true_src") == F.sort_array("p_src"))
              & (F.sort_array("true_dst") == F.sort_array("p_dst")))
    return a.select("edge_id", "type_id", "p_rel", "p_src", "p_dst", "true_rel", "true_src", "true_dst",
                    _flag(non_strict).alias("correct_non_strict"), _flag(strict).alias("correct_strict"))
