"""Property type and relationship cardinality inference (INF1-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsift.functions import typing as ty

# ---- fixed values: properties never typed / never exported -------------------
IGNORED_PROPERTIES = ["original_label"]
# -------------------------------------------------------------------------------


def property_values(df: DataFrame, keep_nulls: bool = False) -> DataFrame:
    """Long form (property, value) of a canonical table's property map."""
    m = F.col("props") if keep_nulls else F.map_filter("props", lambda k, v: v.isNotNull())
    return df.select(F.explode(m).alias("property", "value"))


def infer_property_types(df: DataFrame, date_mode: str = "lenient") -> DataFrame:
    """INF1-7: one type per property, in a single aggregation pass.

    Every value is tested once (native expressions) and the tests are
    combined with ``bool_and`` per property, with map-side partial
    aggregation, so a property holding a third of all values costs one
    partial row per task. Rule order: IP (or ``locationIP``) -> String,
    then Integer, Double, Date, Boolean, else String; a key whose values are
    all null is ``Unknown (empty)`` (same pass: nulls are counted, not tested).
    All values are tested (the reference looks at an arbitrary 1000).
    """
    vals = property_values(df, keep_nulls=True).where(~F.col("property").isin(IGNORED_PROPERTIES))
    agg = ty.tested(vals, "value", date_mode, ["property"])
    t = (F.when(F.col("n_values") == 0, F.lit(ty.EMPTY_TYPE))
         .when((F.col("property") == ty.IP_PROPERTY) | F.col("all_ip"), F.lit("String"))
         .when(F.col("all_int"), F.lit("Integer"))
         .when(F.col("all_double"), F.lit("Double"))
         .when(F.col("all_date"), F.lit("Date"))
         .when(F.col("all_bool"), F.lit("Boolean"))
         .otherwise(F.lit("String")))
    return agg.select("property", t.alias("type"), "n_values")


def annotate_types(types: DataFrame, prop_types: DataFrame,
                   cols: tuple[str, ...] = ("mandatory", "optional")) -> DataFrame:
    """INF8: add ``<col>_typed`` = array<struct<name,type>> for each property list.

    Done by explode + equi-join to the type table + regroup, so the type
    table never goes through the driver. Missing types become ``Unknown``.
    """
    pt = prop_types.select(F.col("property").alias("name"), F.col("type"))

    def tagged(i: int, c: str):
        return F.transform(c, lambda x, at: F.struct(F.lit(i).alias("of"), at.alias("pos"), x.alias("name")))

    listed = types.select("type_id", F.explode(F.concat(*[tagged(i, c) for i, c in enumerate(cols)])).alias("e")).select(
        "type_id", "e.*")
    item = F.struct("pos", "name", F.coalesce("type", F.lit(ty.MISSING_TYPE)).alias("type"))
    typed = listed.join(pt, "name", "left").groupBy("type_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("of") == i, item))).alias(f"{c}_typed") for i, c in enumerate(cols)])
    empty = F.array().cast("array<struct<name:string,type:string>>")
    return types.join(typed, "type_id", "left").withColumns({f"{c}_typed": F.coalesce(F.transform(
        f"{c}_typed", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"))), empty) for c in cols})


def degree_stats(edges: DataFrame) -> DataFrame:
    """INF9: per relation type, distinct targets per source and sources per target.

    Two-level aggregation: distinct (rel, src, dst) with map-side dedup, then
    counts per endpoint (partial counts, so a hub node is pre-aggregated),
    then max/min/avg per relation.
    """
    pairs = edges.select("rel_type", "src_id", "dst_id").distinct()
    out_deg = (pairs.groupBy("rel_type", "src_id").agg(F.count(F.lit(1)).alias("d"))
               .groupBy("rel_type").agg(F.max("d").alias("max_dst_per_src"),
                                        F.min("d").alias("min_dst_per_src"),
                                        F.avg("d").alias("avg_dst_per_src")))
    in_deg = (pairs.groupBy("rel_type", "dst_id").agg(F.count(F.lit(1)).alias("d"))
              .groupBy("rel_type").agg(F.max("d").alias("max_src_per_dst"),
                                       F.min("d").alias("min_src_per_dst"),
                                       F.avg("d").alias("avg_src_per_dst")))
    return out_deg.join(in_deg, "rel_type")


def cardinality_class(max_dst_per_src, max_src_per_dst):
    """INF10: (1,1)=1:1, (>1,1)=1:N, (1,>1)=N:1, (>1,>1)=N:N, else Unknown."""
    d, s = F.col(max_dst_per_src), F.col(max_src_per_dst)
    return (F.when((d == 1) & (s == 1), F.lit("1:1"))
            .when((d > 1) & (s == 1), F.lit("1:N"))
            .when((d == 1) & (s > 1), F.lit("N:1"))
            .when((d > 1) & (s > 1), F.lit("N:N"))
            .otherwise(F.lit("Unknown")))


def infer_cardinality(edges: DataFrame) -> DataFrame:
    """(rel_type, degree statistics..., cardinality) per relation type."""
    st = degree_stats(edges)
    return st.withColumn("cardinality", cardinality_class("max_dst_per_src", "max_src_per_dst"))


def type_cardinality(edge_types: DataFrame, card: DataFrame) -> DataFrame:
    """Attach the comma-joined cardinality classes of each type's relation types."""
    ex = edge_types.select("type_id", F.posexplode("rel_types").alias("pos", "rel_type"))
    per = (ex.join(card.select("rel_type", "cardinality"), "rel_type", "left")
           .groupBy("type_id")
           .agg(F.array_sort(F.collect_list(F.struct(
               "pos", F.coalesce("cardinality", F.lit("Unknown")).alias("c")))).alias("_c")))
    per = per.select("type_id", F.array_join(F.transform("_c", lambda s: s["c"]), ",")
                     .alias("cardinality"))
    return edge_types.join(per, "type_id", "left")
