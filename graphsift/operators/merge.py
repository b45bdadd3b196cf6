"""Merging clusters into node and edge types (MRG1-12).

Inputs are *assigned patterns*: distinct patterns with their weight ``n``
and a ``cluster_id`` (exact or LSH). Outputs are type-level tables; the
per-element membership is never materialised as arrays of ids; instance
level operators join elements to the pattern -> type table instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphsift.functions.text import split_key
from graphsift.operators.components import connected_components
from graphsift.operators.similarity import distinct_sets, jaccard_join
from graphsift.session import cut_lineage


def _empty():
    return F.array().cast("array<string>")


def _nonblank(c):
    return F.array_sort(F.array_distinct(F.filter(c, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")))


def _unions(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, cols...): the sorted union of each array column per key, of keys with
    any item. Items are gathered as sets, so a row holds only the unions."""
    def tagged(i: int, c: str):
        return F.transform(c, lambda x: F.struct(F.lit(i).alias("of"), x.alias("item")))

    items = df.select(key, F.explode(F.concat(*[tagged(i, c) for i, c in enumerate(cols)])).alias("_e"))
    return items.groupBy(key).agg(*[F.array_sort(F.collect_set(F.when(F.col("_e.of") == i, F.col("_e.item")))).alias(c)
                                    for i, c in enumerate(cols)])


def _with_unions(df: DataFrame, key: str, cols: list[str], *aggs) -> DataFrame:
    """Aggregates per key plus the union of each array column (empty if none)."""
    out = df.groupBy(key).agg(*aggs) if aggs else df.select(key).distinct()
    plain = df.withColumns({c: F.coalesce(c, _empty()) for c in cols})
    return out.join(_unions(plain, key, cols), key, "left").withColumns({c: F.coalesce(c, _empty()) for c in cols})


def _property_counts(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n, common, optional) of (keys..., prop_keys, w, n): ``common`` are the
    properties whose weights ``w`` add up to the weight of all rows of the keys.

    Two aggregations: weights per property, with the whole as the null property,
    then one row per keys."""
    whole = F.array(F.lit(None).cast("string"))
    per = (units.select(*keys, "w", "n", F.explode(F.concat(whole, F.coalesce("prop_keys", _empty()))).alias("prop"))
           .groupBy(*keys, "prop").agg(F.sum("w").alias("cnt"), F.sum("n").alias("n")))
    is_whole = F.col("prop").isNull()
    gathered = per.groupBy(*keys).agg(
        F.max(F.when(is_whole, F.col("cnt"))).alias("total"), F.max(F.when(is_whole, F.col("n"))).alias("n"),
        F.array_sort(F.collect_list(F.when(~is_whole, F.struct("prop", "cnt")))).alias("counts"))

    def names(test):
        return F.transform(F.filter("counts", test), lambda x: x["prop"])

    return gathered.select(*keys, "n", names(lambda x: x["cnt"] == F.col("total")).alias("common"),
                           names(lambda x: x["cnt"] != F.col("total")).alias("optional"))


# --------------------------------------------------------------------------- nodes

def node_clusters(assigned: DataFrame) -> DataFrame:
    """Cluster table: label sets seen (blank removed), union of properties, size."""
    return (_with_unions(assigned.withColumnRenamed("prop_keys", "props"), "cluster_id", ["props"],
                         _nonblank(F.collect_set("labels_key")).alias("labels"), F.sum("n").alias("n"))
            .select("cluster_id", "labels", "props", "n"))


def _best_match(pairs: DataFrame, multi: bool) -> DataFrame:
    """Keep the highest Jaccard per unlabelled cluster; ties -> smallest type id."""
    if multi:
        return pairs
    w = Window.partitionBy("a").orderBy(F.col("jaccard").desc(), F.col("b"))
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def assign_node_types(assigned: DataFrame, threshold: float = 0.9, multi: bool = False) -> DataFrame:
    """MRG1-3: cluster -> type assignment.

    Labelled clusters group by their sorted label-set list (MRG1). Unlabelled
    clusters attach to the labelled type whose property union has Jaccard >=
    ``threshold`` with theirs (MRG2; best match, or every match with
    ``multi=True``). The rest become abstract types, one per cluster (MRG3).
    Returns (cluster_id, type_id, labels, is_abstract, attach_jaccard).
    """
    clusters = cut_lineage(node_clusters(assigned))
    labelled = clusters.where(F.size("labels") > 0) \
        .select("cluster_id", F.array_join("labels", "|").alias("type_id"), "labels", "props")
    unlabelled = clusters.where(F.size("labels") == 0).select("cluster_id", "props")

    label_types = cut_lineage(_with_unions(labelled, "type_id", ["props"], F.first("labels").alias("labels")))

    pairs = jaccard_join(unlabelled, label_types, "cluster_id", "props", "type_id", "props",
                         threshold=threshold)
    matched = _best_match(pairs, multi).select(
        F.col("a").alias("cluster_id"), F.col("b").alias("type_id"),
        F.col("jaccard").alias("attach_jaccard"))
    matched = matched.join(label_types.select("type_id", "labels"), "type_id")

    own = labelled.select("cluster_id", "type_id", "labels",
                          F.lit(None).cast("double").alias("attach_jaccard"))
    abstract = (unlabelled.join(matched.select("cluster_id"), "cluster_id", "left_anti")
                .select("cluster_id", F.concat(F.lit("?"), "cluster_id").alias("type_id"),
                        _empty().alias("labels"), F.lit(None).cast("double").alias("attach_jaccard")))
    out = own.unionByName(matched.select(*own.columns)).unionByName(abstract)
    return out.withColumn("is_abstract", F.size("labels") == 0)


def split_properties(pattern_types: DataFrame, granularity: str = "instance") -> DataFrame:
    """MRG4: mandatory / optional properties per type, count form.

    ``instance``: mandatory iff every member element carries it (sum of
    pattern weights equals the type size). ``cluster``: mandatory iff every
    member cluster has it somewhere (the reference's node rule). Both are two
    small aggregations over patterns; no per-type array intersection chain.
    Input needs type_id, prop_keys, n (+ cluster_id for ``cluster``).
    """
    if granularity == "instance":
        units = pattern_types.select("type_id", "prop_keys", F.col("n").alias("w"), "n")
    elif granularity == "cluster":
        pairs = pattern_types.select("type_id", "cluster_id").distinct()
        nothing = F.lit(0).cast("bigint")
        units = (pairs.join(_unions(pattern_types, "cluster_id", ["prop_keys"]), "cluster_id", "left")
                 .select("type_id", "prop_keys", F.lit(1).cast("bigint").alias("w"), nothing.alias("n"))
                 .unionByName(pattern_types.select("type_id", _empty().alias("prop_keys"), nothing.alias("w"), "n")))
    else:
        raise ValueError(f"unknown granularity {granularity!r}")
    return _property_counts(units, ["type_id"]).select("type_id", "n", F.col("common").alias("mandatory"), "optional")


def merge_node_types(assigned: DataFrame, threshold: float = 0.9, multi: bool = False,
                     granularity: str = "instance", keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Node types and the pattern -> type table.

    ``keep`` materialises the cluster -> type assignment once (it feeds both
    outputs), e.g. :func:`graphsift.session.cut_lineage`.

    Returns (node_types(type_id, labels, is_abstract, n, n_clusters, mandatory,
    optional), pattern_types(labels_key, prop_keys, n, cluster_id, type_id)).
    """
    ctype = keep(assign_node_types(assigned, threshold, multi))
    pattern_types = assigned.join(ctype.select("cluster_id", "type_id"), "cluster_id")
    meta = ctype.groupBy("type_id").agg(F.first("labels").alias("labels"),
                                        F.first("is_abstract").alias("is_abstract"),
                                        F.countDistinct("cluster_id").alias("n_clusters"))
    props = split_properties(pattern_types, granularity)
    types = meta.join(props, "type_id").select(
        "type_id", "labels", "is_abstract", "n", "n_clusters", "mandatory", "optional")
    return types, pattern_types


# --------------------------------------------------------------------------- edges

def edge_clusters(assigned: DataFrame) -> DataFrame:
    """Edge cluster table: relation types, endpoint label sets (blank removed)."""
    return (assigned.groupBy("cluster_id")
            .agg(F.array_sort(F.collect_set("rel_type")).alias("rel_types"),
                 _nonblank(F.collect_set("src_key")).alias("src_labels"),
                 _nonblank(F.collect_set("dst_key")).alias("dst_labels"),
                 F.sum("n").alias("n")))


def assign_edge_types(assigned: DataFrame, by: str = "rel_type") -> DataFrame:
    """MRG6/MRG7: cluster -> edge type.

    ``by="rel_type"`` merges clusters with equal relation-type lists and
    unions their endpoint labels (the reference's main path); ``by="endpoints"``
    merges on (relation types, source labels, target labels). Clusters whose
    endpoints are all unlabelled stay separate types.
    """
    c = cut_lineage(edge_clusters(assigned))
    has_labels = (F.size("src_labels") > 0) | (F.size("dst_labels") > 0)
    if by == "rel_type":
        key = F.array_join("rel_types", "|")
    elif by == "endpoints":
        key = F.concat_ws(">", F.array_join("rel_types", "|"), F.array_join("src_labels", "|"),
                          F.array_join("dst_labels", "|"))
    else:
        raise ValueError(f"unknown merge key {by!r}")
    return c.select("cluster_id", "rel_types", "src_labels", "dst_labels",
                    F.when(has_labels, key).otherwise(F.concat(F.lit("?"), "cluster_id"))
                    .alias("type_id"))


def merge_edge_types(assigned: DataFrame, by: str = "rel_type",
                     keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Edge types (type_id, rel_types, src_labels, dst_labels, n, mandatory, optional)
    and the pattern -> type table."""
    ctype = keep(assign_edge_types(assigned, by))
    pattern_types = assigned.join(ctype.select("cluster_id", "type_id"), "cluster_id")
    meta = _with_unions(ctype, "type_id", ["rel_types", "src_labels", "dst_labels"])
    props = split_properties(pattern_types, "instance")
    types = meta.join(props, "type_id").select(
        "type_id", "rel_types", "src_labels", "dst_labels", "n", "mandatory", "optional")
    return types, pattern_types


# --------------------------------------------------------------- Jaccard merge (MRG5)

def jaccard_pairs(clusters: DataFrame, threshold: float = 0.9, set_col: str = "labels") -> DataFrame:
    """Links between clusters whose label sets have Jaccard >= threshold.

    Clusters with equal sets hang on the smallest of them (``a`` = that id,
    ``b`` = the member, jaccard 1); different sets are linked once, between
    their smallest ids. So k clusters of one label give k - 1 rows, not
    k(k - 1)/2, and no link between different sets is lost.
    """
    reps, members = distinct_sets(clusters, "cluster_id", set_col)
    stars = members.where(F.col("id") != F.col("rep")).select(
        F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    return stars.unionByName(jaccard_join(reps, None, "rep", "set", threshold=threshold)
                             .select("a", "b", "jaccard"))


def merge_by_jaccard(clusters: DataFrame, threshold: float = 0.9, closure: str = "components",
                     set_col: str = "labels") -> DataFrame:
    """MRG5: merge clusters whose label sets are similar.

    ``components`` (default): transitive closure, every cluster in exactly one
    group (group_id = smallest member id). ``one_hop``: the reference's groups
    (a set and the later sets similar to it), so a cluster may sit in several
    groups; a group is named by the smallest ids of its sets. Clusters
    without a match or label stay alone. Output: group_id, n_clusters, labels,
    props, n.
    """
    if closure == "components":
        member = (connected_components(clusters.select(F.col("cluster_id").alias("id")),
                                       jaccard_pairs(clusters, threshold, set_col))
                  .select(F.col("component").alias("group_id"), F.col("id").alias("cluster_id")))
    elif closure == "one_hop":
        reps, members = (cut_lineage(x) for x in distinct_sets(clusters, "cluster_id", set_col))
        links = jaccard_join(reps, None, "rep", "set", threshold=threshold)
        linked = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
        lonely = reps.join(linked, "rep", "left_anti").select(F.array("rep").alias("sets"))
        sets = (links.groupBy("a").agg(F.collect_set("b").alias("bs"))
                .select(F.array_sort(F.array_union(F.array("a"), "bs")).alias("sets")).unionByName(lonely))
        groups = sets.select(F.array_join("sets", ";").alias("group_id"), "sets").distinct()
        member = (groups.select("group_id", F.explode("sets").alias("rep")).join(members, "rep")
                  .select("group_id", F.col("id").alias("cluster_id")))
        alone = clusters.select("cluster_id").join(members.select(F.col("id").alias("cluster_id")),
                                                   "cluster_id", "left_anti")
        member = member.unionByName(alone.select(F.col("cluster_id").alias("group_id"), "cluster_id"))
    else:
        raise ValueError(f"unknown closure {closure!r}")
    joined = cut_lineage(member.join(clusters, "cluster_id"))
    return (_with_unions(joined, "group_id", ["labels", "props"], F.count(F.lit(1)).alias("n_clusters"),
                         F.sum("n").alias("n"))
            .select("group_id", "n_clusters", "labels", "props", "n"))


# ------------------------------------------------------- merging two schemas (MRG8/9)

def merge_schemas(*types: DataFrame, key: str = "type_id") -> DataFrame:
    """MRG8/MRG9: merge type tables discovered on parts of a graph.

    Types with the same key are merged; a property is mandatory iff it is
    mandatory in every part where the type occurs (exact for the union of
    the parts); every other property seen is optional; sizes add up.
    Input columns: key, n, mandatory, optional (+ any array columns listed in
    ``labels``/``rel_types``/``src_labels``/``dst_labels`` which are unioned).
    """
    arrays = [c for c in ("labels", "rel_types", "src_labels", "dst_labels") if c in types[0].columns]
    parts = None
    for i, t in enumerate(types):
        x = t.select(key, "n", "mandatory", "optional", *arrays).withColumn("_part", F.lit(i))
        parts = x if parts is None else parts.unionByName(x)
    meta = _with_unions(parts, key, arrays, F.sum("n").alias("n"), F.countDistinct("_part").alias("_parts"))
    props = (parts.select(key, "_part", F.explode("mandatory").alias("prop"), F.lit(1).alias("m"))
             .unionByName(parts.select(key, "_part", F.explode("optional").alias("prop"), F.lit(0).alias("m")))
             .groupBy(key, "prop").agg(F.sum("m").alias("m")))
    flags = props.join(meta.select(key, "_parts"), key).withColumn("mand", F.col("m") == F.col("_parts"))
    split = flags.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("mand"), F.col("prop")))).alias("mandatory"),
        F.array_sort(F.collect_list(F.when(~F.col("mand"), F.col("prop")))).alias("optional"))
    return (meta.join(split, key, "left").drop("_parts")
            .withColumn("mandatory", F.coalesce("mandatory", _empty()))
            .withColumn("optional", F.coalesce("optional", _empty())))


# ------------------------------------------------------------- profiles (MRG10/11)

def _profile(units: DataFrame, keys: list[str]) -> DataFrame:
    """Count-form split over (keys..., prop_keys, n) rows."""
    return (_property_counts(units.withColumn("w", F.col("n")), keys)
            .withColumn("all_props", F.array_sort(F.concat("common", "optional"))))


def profile_by_label(node_pats: DataFrame) -> DataFrame:
    """MRG10: per single label: properties on every node carrying it, the rest optional."""
    units = (node_pats.where(F.col("labels_key") != "")
             .select(F.explode(split_key("labels_key")).alias("label"), "prop_keys", "n"))
    return _profile(units, ["label"])


def profile_by_edge_type(edge_pats: DataFrame) -> DataFrame:
    """MRG11: per (relation, source label set, target label set)."""
    units = edge_pats.select(F.col("rel_type").alias("rel_types"), F.col("src_key").alias("src_labels"),
                             F.col("dst_key").alias("dst_labels"), "prop_keys", "n")
    return _profile(units, ["rel_types", "src_labels", "dst_labels"])


def safe_flatten(df: DataFrame, col: str) -> DataFrame:
    """MRG12: flatten ``col`` only when it is an array of arrays."""
    from pyspark.sql.types import ArrayType
    if col not in df.columns:
        return df
    dt = df.schema[col].dataType
    if isinstance(dt, ArrayType) and isinstance(dt.elementType, ArrayType):
        return df.withColumn(col, F.flatten(col))
    return df
