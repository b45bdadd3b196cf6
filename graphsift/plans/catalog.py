"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the fixture graph built from the driver's tables and
renders arrays as sorted, joined strings so results hash equally on Spark
and DuckDB. Oracle SQL for each key lives in ``oracle_catalog``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsift.operators import infer, merge, patterns
from graphsift.plans.discovery import GraphSchema, discover_schema
from graphsift.session import cut_lineage
from graphsift.sources.fixture import fixture_graph, fixture_raw_edges
from graphsift.sources.graph import as_often

Query = Callable[[SparkSession, str], DataFrame]


def _j(c, sep: str = ",") -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(col), sep)


def graph(spark: SparkSession, sf_dir: str, values: bool = True) -> tuple[DataFrame, DataFrame]:
    return fixture_graph(spark, sf_dir, values)


def named_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph for what needs names and labels only: no property values."""
    return graph(spark, sf_dir, False)


def schema(spark: SparkSession, sf_dir: str, **kw) -> GraphSchema:
    nodes, _ = graph(spark, sf_dir)
    _, edges = named_graph(spark, sf_dir)
    return discover_schema(nodes, edges, raw_edges=fixture_raw_edges(spark, sf_dir), **kw)


def _props_text(c: str = "props") -> F.Column:
    return F.array_join(F.array_sort(F.transform(
        F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


# ---------------------------------------------------------------- sources / encoding

def q_node_scan(spark, sf_dir):
    nodes, _ = graph(spark, sf_dir)
    return nodes.select("node_id", F.array_join(F.array_sort("labels"), ":").alias("labels_key"),
                        F.size("props").cast("bigint").alias("n_props"), _props_text().alias("props_text"))


def q_edge_scan(spark, sf_dir):
    _, edges = graph(spark, sf_dir)
    return edges.select("edge_id", "rel_type", "src_id", "dst_id",
                        _j("src_labels", ":").alias("src_key"), _j("dst_labels", ":").alias("dst_key"),
                        _props_text().alias("props_text"))


def q_node_patterns(spark, sf_dir):
    nodes, _ = named_graph(spark, sf_dir)
    return patterns.node_patterns(nodes).select(
        "labels_key", F.array_join("prop_keys", ",").alias("props_key"), "n")


def q_edge_patterns(spark, sf_dir):
    _, edges = named_graph(spark, sf_dir)
    return patterns.edge_patterns(edges).select(
        "rel_type", "src_key", "dst_key", F.array_join("prop_keys", ",").alias("props_key"), "n")


def q_property_names(spark, sf_dir):
    nodes, edges = named_graph(spark, sf_dir)
    return (patterns.property_names(nodes).withColumn("kind", F.lit("node"))
            .unionByName(patterns.property_names(edges).withColumn("kind", F.lit("edge"))))


def q_presence_flags(spark, sf_dir):
    nodes, _ = named_graph(spark, sf_dir)
    return patterns.presence_flags(nodes).drop("labels", "props")


def q_label_set_count(spark, sf_dir):
    nodes, _ = named_graph(spark, sf_dir)
    from graphsift.operators.lsh import label_set_count
    return label_set_count(patterns.node_patterns(nodes))


# ---------------------------------------------------------------- merging / typing

def _node_types_out(types: DataFrame) -> DataFrame:
    return types.select("type_id", _j("labels", "|").alias("labels"), "is_abstract", "n",
                        _j("mandatory").alias("mandatory"), _j("optional").alias("optional"))


def q_node_types(spark, sf_dir):
    return _node_types_out(schema(spark, sf_dir).node_types)


def q_abstract_types(spark, sf_dir):
    return _node_types_out(schema(spark, sf_dir).node_types.where("is_abstract"))


def q_unlabelled_attach(spark, sf_dir):
    nodes, _ = named_graph(spark, sf_dir)
    assigned = patterns.exact_node_clusters(cut_lineage(patterns.node_patterns(nodes)))
    ct = merge.assign_node_types(assigned, 0.9, multi=True)
    return (ct.where(F.col("attach_jaccard").isNotNull())
            .join(assigned.select("cluster_id", "n"), "cluster_id")
            .select("cluster_id", "type_id", F.round("attach_jaccard", 6).alias("jaccard"), "n"))


def q_mandatory_optional_nodes(spark, sf_dir):
    t = schema(spark, sf_dir).node_types
    m = t.select("type_id", F.explode("mandatory").alias("property"), F.lit(True).alias("mandatory"))
    o = t.select("type_id", F.explode("optional").alias("property"), F.lit(False).alias("mandatory"))
    return m.unionByName(o)


def q_mandatory_optional_edges(spark, sf_dir):
    t = schema(spark, sf_dir).edge_types
    m = t.select("type_id", F.explode("mandatory").alias("property"), F.lit(True).alias("mandatory"))
    o = t.select("type_id", F.explode("optional").alias("property"), F.lit(False).alias("mandatory"))
    return m.unionByName(o)


def _edge_types_out(t: DataFrame) -> DataFrame:
    return t.select("type_id", _j("rel_types", "|").alias("rel_types"),
                    _j("src_labels", "|").alias("src_labels"), _j("dst_labels", "|").alias("dst_labels"),
                    "n", _j("mandatory").alias("mandatory"), _j("optional").alias("optional"))


def q_edge_types_by_rel(spark, sf_dir):
    s = schema(spark, sf_dir)
    return _edge_types_out(s.edge_types).join(
        s.edge_types.select("type_id", "cardinality"), "type_id")


def q_edge_types_by_endpoints(spark, sf_dir):
    _, edges = named_graph(spark, sf_dir)
    assigned = patterns.exact_edge_clusters(patterns.edge_patterns(edges))
    types, _ = merge.merge_edge_types(assigned, by="endpoints")
    return _edge_types_out(types)


def q_property_types_nodes(spark, sf_dir):
    nodes, _ = graph(spark, sf_dir)
    return infer.infer_property_types(nodes)


def q_property_types_edges(spark, sf_dir):
    return infer.infer_property_types(fixture_raw_edges(spark, sf_dir))


def q_typed_schema(spark, sf_dir):
    s = schema(spark, sf_dir)
    rows = []
    for kind, t in (("node", s.typed_node_types()), ("edge", s.typed_edge_types())):
        for c, mand in (("mandatory_typed", True), ("optional_typed", False)):
            rows.append(t.select(F.lit(kind).alias("kind"), "type_id",
                                 F.explode(c).alias("p"))
                        .select("kind", "type_id", F.col("p.name").alias("property"),
                                F.col("p.type").alias("type"), F.lit(mand).alias("mandatory")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def q_property_types_strict(spark, sf_dir):
    """Value types where a date must have a whole date's form."""
    nodes, _ = graph(spark, sf_dir)
    out = [infer.infer_property_types(df, "strict").select(F.lit(kind).alias("kind"), "*")
           for kind, df in (("node", nodes), ("edge", fixture_raw_edges(spark, sf_dir)))]
    return out[0].unionByName(out[1])


def q_degree_stats(spark, sf_dir):
    st = infer.degree_stats(fixture_raw_edges(spark, sf_dir))
    return st.select("rel_type", "max_dst_per_src", "min_dst_per_src",
                     F.round("avg_dst_per_src", 6).alias("avg_dst_per_src"),
                     "max_src_per_dst", "min_src_per_dst",
                     F.round("avg_src_per_dst", 6).alias("avg_src_per_dst"))


def q_cardinality(spark, sf_dir):
    return infer.infer_cardinality(fixture_raw_edges(spark, sf_dir)).select("rel_type", "cardinality")


def q_node_schema_flagship(spark, sf_dir):
    """Flagship: typed node schema, one row per (type, property)."""
    s = schema(spark, sf_dir)
    t = s.typed_node_types()
    m = t.select("type_id", "is_abstract", F.explode("mandatory_typed").alias("p"),
                 F.lit(True).alias("mandatory"))
    o = t.select("type_id", "is_abstract", F.explode("optional_typed").alias("p"),
                 F.lit(False).alias("mandatory"))
    return m.unionByName(o).select("type_id", "is_abstract", F.col("p.name").alias("property"),
                                   F.col("p.type").alias("type"), "mandatory")


# ---------------------------------------------------------------- schema sinks

def q_ddl_loose(spark, sf_dir):
    from graphsift.plans.ddl import schema_ddl
    return schema_ddl(schema(spark, sf_dir), "loose").select("section", "line")


def q_ddl_strict(spark, sf_dir):
    from graphsift.plans.ddl import schema_ddl
    return schema_ddl(schema(spark, sf_dir), "strict").select("section", "line")


def q_schema_fields(spark, sf_dir):
    from graphsift.plans.ddl import schema_fields
    return schema_fields(schema(spark, sf_dir))


def q_schema_xsd(spark, sf_dir):
    from graphsift.plans.ddl import schema_fields, schema_xsd
    return schema_xsd(schema_fields(schema(spark, sf_dir))).select("section", "line")


def _rules(shape):
    def q(spark, sf_dir):
        from graphsift.plans.ddl import schema_fields
        from graphsift.plans.rdf import mapping_rules
        return mapping_rules(schema_fields(schema(spark, sf_dir)), shape)
    return q


def _node_quads(shape):
    def q(spark, sf_dir):
        from graphsift.plans.rdf import node_quads
        nodes, _ = graph(spark, sf_dir)
        return node_quads(nodes, schema(spark, sf_dir), shape)
    return q


def _all_edge_quads(spark, sf_dir, shape):
    from graphsift.plans.rdf import raw_edge_quads
    return raw_edge_quads(fixture_raw_edges(spark, sf_dir), graph(spark, sf_dir)[0], shape)


def _edge_quads(shape):
    def q(spark, sf_dir):
        return _all_edge_quads(spark, sf_dir, shape)
    return q


def _rule_quads(shape, **options):
    def q(spark, sf_dir):
        from graphsift.plans.rules import executable_rules, rule_quads
        nodes, _ = graph(spark, sf_dir)
        s = schema(spark, sf_dir)
        return rule_quads(nodes, fixture_raw_edges(spark, sf_dir), s, executable_rules(s, shape, **options), shape=shape)
    return q


def _compared(both: DataFrame, buckets: int = 4096) -> DataFrame:
    """One row (quads of side 1, mismatches) of ``both`` (h, g, side): hashes of the
    two sides, 1 and -1.

    Sums of the hashes' halves, per bucket of hashes and over both sides, are zero
    where the sides are equal; only the buckets where one is not are compared
    hash by hash."""
    low, bits = F.lit((1 << 32) - 1), 32
    bucket = F.pmod("h", F.lit(buckets)).alias("bucket")
    halves = [x for c in ("h", "g") for x in (F.col(c).bitwiseAND(low), F.shiftrightunsigned(c, bits))]
    sums = both.groupBy(bucket).agg(F.sum(F.when(F.col("side") > 0, 1).otherwise(0)).alias("n"), F.sum("side").alias("d0"),
                                    *[F.sum(x * F.col("side")).alias(f"d{i}") for i, x in enumerate(halves, 1)])
    sums = cut_lineage(sums)
    unequal = sums.where(" OR ".join(f"d{i} <> 0" for i in range(5))).select("bucket")
    quads = sums.agg(F.sum("n").alias("quads"), F.sum(F.lit(0)).alias("mismatches"))
    if unequal.isEmpty():
        return quads
    per = both.withColumn("bucket", bucket).join(F.broadcast(unequal), "bucket").groupBy("h", "g").agg(F.sum("side").alias("d"))
    return quads.select("quads").crossJoin(per.agg(F.sum(F.abs("d")).alias("mismatches")))


def q_rules_vs_quads(spark, sf_dir):
    """Quads by the rules against quads generated directly: how many there
    are, and how many (counted with their number) are not on both sides."""
    from graphsift.plans.rdf import QUAD_COLUMNS, node_quads
    from graphsift.plans.rules import executable_rules, rule_quads
    nodes, _ = graph(spark, sf_dir)
    s = schema(spark, sf_dir)
    out = None
    for shape in ("link", "reified"):
        by_rule = rule_quads(nodes, fixture_raw_edges(spark, sf_dir), s, executable_rules(s, shape), shape=shape)
        direct = node_quads(nodes, s, shape).unionByName(_all_edge_quads(spark, sf_dir, shape))
        # 128 bits of hash stand for a quad, so no text is shuffled.
        key = [F.xxhash64(*QUAD_COLUMNS).alias("h"), F.xxhash64(F.lit(shape), *QUAD_COLUMNS[::-1]).alias("g")]
        both = by_rule.select(*key, F.lit(1).alias("side")).unionByName(direct.select(*key, F.lit(-1).alias("side")))
        row = _compared(both)
        row = row.select(F.lit(shape).alias("shape"), "quads", "mismatches")
        out = row if out is None else out.unionByName(row)
    return out


def q_executable_rules(spark, sf_dir):
    """The rules themselves: endpoints have one for each label set that is there."""
    from graphsift.plans.rules import executable_rules
    out = None
    s = schema(spark, sf_dir)
    for shape in ("link", "reified"):
        rules = executable_rules(s, shape).select(F.lit(shape).alias("shape"), "kind", "key", "rule",
                                                  F.replace("slot", F.lit("\u0001"), F.lit("@")).alias("slot"),
                                                  "subject", "predicate", "object", "object_kind")
        out = rules if out is None else out.unionByName(rules)
    return out


def q_rule_classes(spark, sf_dir):
    """Node classes with one class per label."""
    from graphsift.plans.rdf import RDF_TYPE
    from graphsift.plans.rules import executable_rules, rule_quads
    nodes, _ = graph(spark, sf_dir)
    s = schema(spark, sf_dir)
    quads = rule_quads(nodes, None, s, executable_rules(s, "reified", classes="labels"))
    return quads.where(F.col("predicate") == RDF_TYPE).select("subject", "object")


def q_rule_quads_hashed(spark, sf_dir):
    """Another policy in the rules: all element IRIs are digests."""
    return _rule_quads("link", generator="URIwithTypeHashed")(spark, sf_dir).select("subject", "predicate", "object", "object_kind")


def q_iri_policies(spark, sf_dir):
    """Every standard policy over nodes; texts of URIorUUID are a property or an IRI."""
    from graphsift.functions.text import label_key
    from graphsift.plans.policies import POLICIES, mint
    from graphsift.plans.rdf import DEFAULT_BASE, node_iri, node_segment
    nodes, _ = graph(spark, sf_dir)
    key, plain = label_key("labels"), F.col("node_id").cast("string")
    text = F.when(F.col("node_id") % 2 == 0, node_iri(DEFAULT_BASE, key, F.col("node_id"))).otherwise(F.col("props")["name"])
    holes = {"type": node_segment(key), "id": plain, "label": plain, "text": text}
    return nodes.select("node_id", *[mint(p, holes, {"custom": DEFAULT_BASE + "custom/"}).alias(p.name) for p in POLICIES])


def q_nquads_lines(spark, sf_dir):
    from graphsift.plans.rdf import node_quads, nquads_lines
    nodes, _ = graph(spark, sf_dir)
    s = schema(spark, sf_dir)
    return nquads_lines(node_quads(nodes, s, "link").unionByName(_all_edge_quads(spark, sf_dir, "link")))


def q_iri_modes(spark, sf_dir):
    """RDF4: node IRI in both namespaces plus a hashed variant and graph IRI."""
    from graphsift.plans.rdf import DEFAULT_BASE, node_iri
    nodes, _ = graph(spark, sf_dir)
    k = nodes.select("node_id", F.array_join(F.sort_array(F.array_distinct("labels")), ":").alias("lk"))
    plain = node_iri(DEFAULT_BASE, F.col("lk"), F.col("node_id"))
    return k.select("node_id", plain.alias("iri"),
                    node_iri(DEFAULT_BASE + "custom/", F.col("lk"), F.col("node_id")).alias("iri_custom"),
                    F.concat(F.lit(DEFAULT_BASE + "custom/"), F.sha2(plain, 256)).alias("iri_hashed"),
                    F.concat(plain, F.lit("/graph")).alias("graph_iri"))


# ---------------------------------------------------------------- evaluation

def _node_assign(spark, sf_dir):
    from graphsift.operators.evaluate import assignments_nodes
    from graphsift.sources.fixture import truth_label
    nodes, _ = named_graph(spark, sf_dir)
    s = schema(spark, sf_dir)
    # ground truth follows from the id (source table), so it is computed inline
    return assignments_nodes(nodes, s.node_pattern_types, s.node_types,
                             F.array(truth_label(F.col("node_id"))))


def _metrics_out(m):
    return m.select("tp", "fp", "fn", "true_sets", "predicted_types",
                    F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
                    F.round("f1", 6).alias("f1"), "non_strict_correct", "strict_correct")


def q_eval_nodes(spark, sf_dir):
    from graphsift.operators.evaluate import clustering_metrics
    a = _node_assign(spark, sf_dir)
    return _metrics_out(clustering_metrics(a, F.array_join(F.sort_array("actual_labels"), ",")))


def q_assignments_nodes(spark, sf_dir):
    a = _node_assign(spark, sf_dir)
    return a.select("node_id", "type_id", _j("predicted_labels").alias("predicted_labels"),
                    _j("actual_labels").alias("actual_labels"), "correct_non_strict", "correct_strict")


def q_majority_labels(spark, sf_dir):
    from graphsift.operators.evaluate import majority_labels
    return majority_labels(_node_assign(spark, sf_dir))


def q_eval_edges(spark, sf_dir):
    from graphsift.operators.evaluate import assignments_edges, clustering_metrics
    from graphsift.sources.fixture import truth_label
    _, edges = named_graph(spark, sf_dir)
    s = schema(spark, sf_dir)
    truth = {"true_rel": F.array("rel_type"), "true_src": F.array(truth_label(F.col("src_id"))),
             "true_dst": F.array(truth_label(F.col("dst_id")))}
    a = assignments_edges(edges, s.edge_pattern_types, s.edge_types, truth)
    key = F.concat_ws(">", F.array_join("true_rel", ","), F.array_join("true_src", ","),
                      F.array_join("true_dst", ","))
    return _metrics_out(clustering_metrics(a, key, actual="true_rel"))


# ---------------------------------------------------------------- more merging

def _exact_clusters(spark, sf_dir):
    nodes, _ = named_graph(spark, sf_dir)
    return cut_lineage(merge.node_clusters(patterns.exact_node_clusters(cut_lineage(patterns.node_patterns(nodes)))))


def q_jaccard_pairs(spark, sf_dir):
    return merge.jaccard_pairs(_exact_clusters(spark, sf_dir), 0.9).select(
        "a", "b", F.round("jaccard", 6).alias("jaccard"))


def q_jaccard_pairs_props(spark, sf_dir):
    """Partial overlaps: clusters whose property sets share at least 0.3."""
    return merge.jaccard_pairs(_exact_clusters(spark, sf_dir), 0.3, "props").select(
        "a", "b", F.round("jaccard", 6).alias("jaccard"))


def _jmerge(closure):
    def q(spark, sf_dir):
        g = merge.merge_by_jaccard(_exact_clusters(spark, sf_dir), 0.9, closure)
        return g.select("group_id", "n_clusters", _j("labels", "|").alias("labels"),
                        _j("props").alias("props"), "n")
    return q


def _halves(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    raw = fixture_raw_edges(spark, sf_dir)
    even = discover_schema(nodes.where(F.expr("(node_id div 16) % 2 = 0")), edges.where(F.expr("(src_id div 16) % 2 = 0")),
                           raw_edges=raw.where(F.expr("(src_id div 16) % 2 = 0")))
    odd = discover_schema(nodes.where(F.expr("(node_id div 16) % 2 = 1")), edges.where(F.expr("(src_id div 16) % 2 = 1")),
                          raw_edges=raw.where(F.expr("(src_id div 16) % 2 = 1")))
    return even, odd


def q_schema_merge_nodes(spark, sf_dir):
    even, odd = _halves(spark, sf_dir)
    m = merge.merge_schemas(even.node_types, odd.node_types)
    return m.select("type_id", _j("labels", "|").alias("labels"), "n",
                    _j("mandatory").alias("mandatory"), _j("optional").alias("optional"))


def q_schema_merge_edges(spark, sf_dir):
    even, odd = _halves(spark, sf_dir)
    m = merge.merge_schemas(even.edge_types, odd.edge_types)
    return m.select("type_id", _j("rel_types", "|").alias("rel_types"), _j("src_labels", "|").alias("src_labels"),
                    _j("dst_labels", "|").alias("dst_labels"), "n",
                    _j("mandatory").alias("mandatory"), _j("optional").alias("optional"))


def q_label_profile(spark, sf_dir):
    nodes, _ = named_graph(spark, sf_dir)
    p = merge.profile_by_label(cut_lineage(patterns.node_patterns(nodes)))
    return p.select("label", "n", _j("common").alias("common"), _j("optional").alias("optional"),
                    _j("all_props").alias("all_props"))


def q_edge_profile(spark, sf_dir):
    _, edges = named_graph(spark, sf_dir)
    p = merge.profile_by_edge_type(cut_lineage(patterns.edge_patterns(edges)))
    return p.select("rel_types", "src_labels", "dst_labels", "n", _j("common").alias("common"),
                    _j("optional").alias("optional"), _j("all_props").alias("all_props"))


def q_flatten_props(spark, sf_dir):
    nodes, _ = named_graph(spark, sf_dir)
    a = patterns.exact_node_clusters(patterns.node_patterns(nodes))
    nested = a.groupBy("cluster_id").agg(F.collect_set("prop_keys").alias("props"))
    flat = merge.safe_flatten(merge.safe_flatten(nested, "props"), "props")
    return flat.select("cluster_id", _j(F.array_distinct("props")).alias("props"))


def q_node_types_cluster_granularity(spark, sf_dir):
    return _node_types_out(schema(spark, sf_dir, granularity="cluster").node_types)


def q_node_types_multi(spark, sf_dir):
    """Reference attachment rule: an unlabelled cluster joins every matching type."""
    return _node_types_out(schema(spark, sf_dir, multi=True).node_types)


# ---------------------------------------------------------------- LSH (rows-only)

def q_encoded_patterns(spark, sf_dir):
    from graphsift.operators.encode import encode_node_patterns
    nodes, _ = named_graph(spark, sf_dir)
    enc = encode_node_patterns(patterns.node_patterns(nodes))
    return enc.select("labels_key", F.array_join("prop_keys", ",").alias("props_key"), "n",
                      F.size("features_arr").alias("dim"),
                      F.array_join(F.slice(F.transform("features_arr", lambda x: x.cast("string")),
                                           6, F.size("features_arr")), ",").alias("flags"))


def q_encoded_edge_patterns(spark, sf_dir):
    """Edge features with codes that any engine can recompute."""
    from graphsift.operators.encode import encode_edge_patterns
    _, edges = named_graph(spark, sf_dir)
    enc = encode_edge_patterns(cut_lineage(patterns.edge_patterns(edges)), code="hash")
    return enc.select("rel_type", "src_key", "dst_key", F.array_join("prop_keys", ",").alias("props_key"), "n",
                      F.size("features_arr").alias("dim"),
                      *[F.round(F.element_at("features_arr", i), 6).alias(f"f{i}") for i in (1, 10, 11, 15, 18)],
                      F.array_join(F.slice(F.transform("features_arr", lambda x: x.cast("string")),
                                           19, F.size("features_arr")), ",").alias("flags"))


def q_encoded_node_codes(spark, sf_dir):
    """Node features with codes that any engine can recompute."""
    from graphsift.operators.encode import encode_node_patterns
    nodes, _ = named_graph(spark, sf_dir)
    enc = encode_node_patterns(cut_lineage(patterns.node_patterns(nodes)), code="hash")
    return enc.select("labels_key", F.array_join("prop_keys", ",").alias("props_key"), "n", F.size("features_arr").alias("dim"),
                      *[F.round(F.element_at("features_arr", i), 6).alias(f"f{i}") for i in range(1, 6)])


def _encoded(spark, sf_dir):
    """Node and edge patterns with recomputable codes, each cut into a table."""
    from graphsift.operators.encode import encode_edge_patterns, encode_node_patterns
    nodes, edges = named_graph(spark, sf_dir)
    return (cut_lineage(encode_node_patterns(cut_lineage(patterns.node_patterns(nodes)), code="hash")),
            cut_lineage(encode_edge_patterns(cut_lineage(patterns.edge_patterns(edges)), code="hash")))


def q_pattern_distance_stats(spark, sf_dir):
    from graphsift.operators.lsh import pattern_distance_stats
    out = None
    for kind, enc in zip(("node", "edge"), _encoded(spark, sf_dir)):
        st = pattern_distance_stats(enc).select(
            F.lit(kind).alias("kind"), *[F.round(f"{c}_distance", 6).alias(f"{c}_distance")
                                         for c in ("avg", "min", "max")], "pairs")
        out = st if out is None else out.unionByName(st)
    return out


def q_lsh_params(spark, sf_dir):
    from graphsift.operators.lsh import lsh_params_table
    n, e = _encoded(spark, sf_dir)
    out = lsh_params_table(n, False).withColumn("kind", F.lit("node")).unionByName(
        lsh_params_table(e, True).withColumn("kind", F.lit("edge")))
    return out.select("kind", F.round("avg_distance", 6).alias("avg_distance"), "rows", "label_sets",
                      F.round("bucket_length", 6).alias("bucket_length"), "num_tables")


def q_lsh_invariants(spark, sf_dir):
    """What holds for LSH clusters whatever the random projections are: every
    pattern and element is in exactly one cluster, and a tiny bucket gives the
    exact clusters."""
    from graphsift.operators.lsh import lsh_cluster_edges, lsh_cluster_nodes
    nodes, edges = named_graph(spark, sf_dir)
    out = None
    for kind, pats, cluster, key in (
            ("node", patterns.node_patterns(nodes), lsh_cluster_nodes, patterns.NODE_KEY),
            ("edge", patterns.edge_patterns(edges), lsh_cluster_edges, patterns.EDGE_KEY)):
        pats = cut_lineage(pats)
        given = cut_lineage(cluster(pats))
        tiny = cluster(pats, bucket_length=1e-7, num_tables=4).agg(
            F.countDistinct("cluster_id").alias("exact_clusters"))
        per = pats.select(*key, "n").join(given.groupBy(*key).agg(F.count("*").alias("times")), key, "left")
        row = per.agg(F.count("*").alias("patterns"), F.sum("n").alias("elements"),
                      F.sum(F.when(F.col("times").isNull(), 1).otherwise(0)).alias("unassigned"),
                      F.sum(F.when(F.col("times") > 1, 1).otherwise(0)).alias("assigned_twice"))
        row = row.select(F.lit(kind).alias("kind"), "*", F.lit(tiny.first()[0]).alias("exact_clusters"))
        out = row if out is None else out.unionByName(row)
    return out


def q_node_lsh(spark, sf_dir):
    from graphsift.operators.lsh import lsh_cluster_nodes
    nodes, _ = named_graph(spark, sf_dir)
    c = lsh_cluster_nodes(patterns.node_patterns(nodes))
    return c.select("labels_key", F.array_join("prop_keys", ",").alias("props_key"), "n", "cluster_id")


def q_edge_lsh(spark, sf_dir):
    from graphsift.operators.lsh import lsh_cluster_edges
    _, edges = named_graph(spark, sf_dir)
    c = lsh_cluster_edges(patterns.edge_patterns(edges))
    return c.select("rel_type", "src_key", "dst_key", F.array_join("prop_keys", ",").alias("props_key"),
                    "n", "cluster_id")


def q_lsh_node_types(spark, sf_dir):
    return _node_types_out(schema(spark, sf_dir, method="lsh").node_types)


# ---------------------------------------------------------------- I/O round trips

def _csv_graph(spark, sf_dir):
    from graphsift.sources.csvio import graph_from_csv, write_graph_csv
    from graphsift.sources.scratch import scratch_path
    nodes, _ = graph(spark, sf_dir)
    edges = as_often(fixture_raw_edges(spark, sf_dir), nodes)       # the files hold no endpoint labels
    npath, epath = write_graph_csv(nodes, edges, scratch_path(spark, "csv"), sep="|", compression="gzip")
    return graph_from_csv(spark, {None: npath}, {None: epath}, sep="|")


def q_csv_round_trip(spark, sf_dir):
    nodes, _ = _csv_graph(spark, sf_dir)
    return nodes.select("node_id", F.array_join(F.sort_array("labels"), ":").alias("labels_key"),
                        F.size("props").cast("bigint").alias("n_props"), _props_text().alias("props_text"))


def q_csv_round_trip_edges(spark, sf_dir):
    _, edges = _csv_graph(spark, sf_dir)
    return edges.select("edge_id", "rel_type", "src_id", "dst_id",
                        _j("src_labels", ":").alias("src_key"), _j("dst_labels", ":").alias("dst_key"),
                        _props_text().alias("props_text"))


def q_csv_bulk_import(spark, sf_dir):
    """Files as bulk importers take them: id spaces, typed headers, and two
    files of one type with different columns in different order."""
    from graphsift.sources.csvio import FORMAT, graph_from_csv
    from graphsift.sources.fixture import table
    from graphsift.sources.scratch import scratch_path
    path = scratch_path(spark, "bulk")

    def put(df, name, sep="|"):
        options = {k: v for k, v in FORMAT.items() if k != "multiLine"} | {"emptyValue": '""', "sep": sep}
        df.write.options(**options).csv(f"{path}/{name}")
        return f"{path}/{name}"

    docs = table(spark, sf_dir, "documents")
    people = table(spark, sf_dir, "customer")
    doc_files = [put(docs.where("doc_id % 2 = 0").selectExpr("doc_id AS `id:ID(Doc)`", "text AS `text:string`"), "doc0"),
                 put(docs.where("doc_id % 2 = 1").selectExpr("lang", "text AS `text:string`", "doc_id AS `id:ID(Doc)`",
                                                             "source AS `x:IGNORE`"), "doc1")]
    who = put(people.selectExpr("c_custkey AS `:ID(Person)`", "c_name AS `name:string`", "'Buyer' AS `:LABEL`"), "person")
    reads = put(people.join(docs, F.col("c_custkey") == F.col("doc_id")).selectExpr(
        "c_custkey AS `:START_ID(Person)`", "doc_id AS `:END_ID(Doc)`", "lang AS `in:string`"), "reads")
    nodes, edges = graph_from_csv(spark, {"Doc": doc_files, None: who}, {"READS": reads})
    n = nodes.select(F.array_join("labels", ":").alias("kind"), F.coalesce(F.col("props")["id"], F.lit("")).alias("id"),
                     _props_text().alias("props_text"))
    e = edges.select(F.concat_ws(">", F.array_join("src_labels", ":"), "rel_type", F.array_join("dst_labels", ":"))
                     .alias("kind"), F.lit("").alias("id"), _props_text().alias("props_text"))
    return n.unionByName(e)


def _party_import(spark, sf_dir, **options):
    """Customers and suppliers in one id space (so ids come twice), orders under
    text ids, and edges of which some lead to ids that no node has."""
    from graphsift.sources.csvio import FORMAT, import_csv
    from graphsift.sources.fixture import table
    from graphsift.sources.scratch import scratch_path
    path = scratch_path(spark, "party")

    def put(name, source, *columns):
        settings = {k: v for k, v in FORMAT.items() if k != "multiLine"} | {"emptyValue": '""', "sep": "|"}
        table(spark, sf_dir, source).selectExpr(*columns).write.options(**settings).csv(f"{path}/{name}")
        return f"{path}/{name}"

    nodes = {"Customer": put("c", "customer", "c_custkey AS `key:ID(Party)`", "c_name AS name"),
             "Supplier": put("s", "supplier", "s_suppkey AS `key:ID(Party)`", "s_name AS name"),
             "Order": put("o", "orders", "concat('order-', o_orderkey) AS `key:ID`", "o_orderstatus AS status"),
             "Nation": put("n", "nation", "n_nationkey AS `key:ID`", "n_name AS `names:string[]`")}
    edges = {"ORDERED": put("oe", "orders", "o_custkey AS `:START_ID(Party)`", "concat('order-', o_orderkey) AS `:END_ID`"),
             "LABELS": put("le", "labels", "doc_id AS `:START_ID(Party)`", "doc_id AS `:END_ID`"),
             "RATES": put("re", "labels", "nullif(doc_id, 0) AS `:START_ID`", "doc_id + 600 AS `:END_ID(Party)`",
                          "quality AS `quality:int`")}
    return import_csv(spark, nodes, edges, multiline_fields=False, one_header=True, **options)


def q_csv_import_report(spark, sf_dir):
    """What an import finds: rows, ids used twice, edges that lead nowhere."""
    return _party_import(spark, sf_dir).report


def q_csv_import_edges(spark, sf_dir):
    """The edges that stay without bad ones, by the keys of the nodes they meet."""
    got = _party_import(spark, sf_dir, skip_duplicate_nodes=True, skip_bad_edges=True)
    key = F.col("props")["key"]
    src = got.nodes.select(F.col("node_id").alias("src_id"), key.alias("src_key"))
    dst = got.nodes.select(F.col("node_id").alias("dst_id"), key.alias("dst_key"))
    return got.edges.join(src, "src_id").join(dst, "dst_id").select(
        "rel_type", "src_key", "dst_key", F.array_join("src_labels", ":").alias("src_label"),
        F.array_join("dst_labels", ":").alias("dst_label"), F.coalesce(F.col("props")["quality"], F.lit("")).alias("quality"))


def q_csv_bad_edges(spark, sf_dir):
    return _party_import(spark, sf_dir).bad_edges


def q_trig_lines(spark, sf_dir):
    from graphsift.plans.rdf import trig_lines
    return trig_lines(_all_edge_quads(spark, sf_dir, "link"))


def _trig_written(shape):
    """All quads of one shape written as grouped TriG and read back."""
    def q(spark, sf_dir):
        from graphsift.plans.rdf import DEFAULT_BASE, namespace
        from graphsift.plans.trig import read_trig, write_trig
        from graphsift.sources.scratch import scratch_path
        path = scratch_path(spark, "trig")
        write_trig(_rule_quads(shape)(spark, sf_dir), path, {"p": namespace(DEFAULT_BASE, shape)},
                   compression="gzip")
        return read_trig(spark, path)
    return q


def q_quads_written(spark, sf_dir):
    """N-Quads written in chunks and read back."""
    from graphsift.plans.rdf import write_quads
    from graphsift.sources.scratch import scratch_path
    path = scratch_path(spark, "quads")
    write_quads(_all_edge_quads(spark, sf_dir, "reified"), path, "nquads", max_records=10_000, compression="gzip")
    return spark.read.text(path).withColumnRenamed("value", "line")


def q_align_union(spark, sf_dir):
    from graphsift.sources.csvio import align_schemas
    a = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    x, y = align_schemas(a, b)
    return x.unionByName(y)


def _elem_props(c: str = "property") -> F.Column:
    entries = F.coalesce(F.transform(c, lambda p: F.concat(p["_name"], F.lit("="), p["_VALUE"])),
                         F.array().cast("array<string>"))
    return F.array_join(F.sort_array(entries), ";")


def q_node_elements(spark, sf_dir):
    from graphsift.sources.scratch import scratch_path
    from graphsift.sources.xmlio import export_node_xml, read_xml_elements
    nodes, _ = graph(spark, sf_dir)
    path = scratch_path(spark, "xml-nodes")
    export_node_xml(nodes, schema(spark, sf_dir), path, compression="gzip")
    r = read_xml_elements(spark, path, "node")
    return r.select("type_name", "id", "original_label", _elem_props().alias("props_text"))


def q_edge_elements(spark, sf_dir):
    from graphsift.sources.scratch import scratch_path
    from graphsift.sources.xmlio import export_edge_xml, read_xml_elements
    _, edges = graph(spark, sf_dir)
    path = scratch_path(spark, "xml-edges")
    export_edge_xml(edges, path, compression="gzip")
    r = read_xml_elements(spark, path, "edge")
    return r.select("type_name", "id", F.coalesce(F.col("source._type"), F.lit("")).alias("src_type"),
                    F.col("source._VALUE").alias("src"),
                    F.coalesce(F.col("target._type"), F.lit("")).alias("dst_type"),
                    F.col("target._VALUE").alias("dst"),
                    _elem_props().alias("props_text"))


def _typed_xml(spark, sf_dir, nodes, edges, items_per_file=10_000):
    """(path, fields, types, xsd path) of a typed export of the given elements by the fixture's schema."""
    from graphsift.sources import xmltyped as x
    from graphsift.sources.scratch import scratch_path
    s = schema(spark, sf_dir, date_mode="strict")      # lenient dates are no xs:date
    path = scratch_path(spark, "xml-typed")
    elements = x.node_elements(nodes, s)
    if edges is not None:
        elements = elements.unionByName(x.edge_elements(edges))
    x.write_typed_xml(elements, f"{path}/data", items_per_file, compression="gzip")
    fields, types = cut_lineage(x.instance_fields(s)), cut_lineage(x.types_of(s))
    return f"{path}/data", fields, types, x.write_xsd(spark, x.instance_xsd(fields, types), path)


def q_typed_elements(spark, sf_dir):
    """Type-named XML written and read back, every type by its own tag."""
    from graphsift.sources.xmltyped import read_all_typed_xml
    path, fields, types, _ = _typed_xml(spark, sf_dir, *graph(spark, sf_dir))
    out = read_all_typed_xml(spark, path, fields, types)
    return out.select("kind", "type_name", "id", "src_labels_key", "src", "dst_labels_key", "dst", _props_text().alias("props_text"))


def q_xml_validation(spark, sf_dir):
    """The export validated by Spark against its own XSD, element by element;
    and the same with some values that the schema does not allow."""
    from graphsift.sources.xmltyped import CORRUPT, read_all_typed_xml
    nodes, edges = graph(spark, sf_dir)
    wrong = F.when((F.col("node_id") % 7 == 0) & F.map_contains_key("props", "acctbal"), F.map_concat(
        F.map_filter("props", lambda k, v: k != "acctbal"), F.create_map(F.lit("acctbal"), F.lit("no number")))).otherwise(F.col("props"))
    out = None
    for name, n, e in (("as_is", nodes, edges), ("broken", nodes.withColumn("props", wrong), None)):
        path, fields, types, xsd = _typed_xml(spark, sf_dir, n, e)
        if e is None:
            types = types.where("kind = 'node'")
        read = read_all_typed_xml(spark, path, fields, types, xsd)
        per = read.groupBy("kind", "type_name").agg(F.count("*").alias("elements"), F.count("id").alias("valid"),
                                                    F.count(CORRUPT).alias("invalid"))
        per = per.select(F.lit(name).alias("run"), "*")
        out = per if out is None else out.unionByName(per)
    return out


def q_xml_chunks(spark, sf_dir):
    """Files of exactly 100 elements, the last of a type the rest: per type and
    number of elements, how many files there are, each opened and closed once."""
    from graphsift.sources.xmltyped import PLAIN_FILES
    nodes, edges = graph(spark, sf_dir)
    path, *_ = _typed_xml(spark, sf_dir, nodes, edges, items_per_file=100)
    lines = spark.read.options(**PLAIN_FILES).text(path).select("kind", "tag", F.input_file_name().alias("file"), "value")
    per = lines.groupBy("kind", "tag", "file").agg(
        F.sum(F.col("value").endswith(F.concat(F.lit("</"), "tag", F.lit(">"))).cast("int")).alias("items"),
        F.sum(F.col("value").rlike("^<[^ >]+Group type=").cast("int")).alias("opened"),
        F.sum(F.col("value").rlike("^</[^>]+Group>$").cast("int")).alias("closed"))
    return per.groupBy("kind", "tag", "items", "opened", "closed").agg(F.count("*").alias("files"))


QUERIES: dict[str, Query] = {
    "node_scan": q_node_scan,
    "edge_scan": q_edge_scan,
    "node_patterns": q_node_patterns,
    "edge_patterns": q_edge_patterns,
    "property_names": q_property_names,
    "presence_flags": q_presence_flags,
    "label_set_count": q_label_set_count,
    "node_types": q_node_types,
    "abstract_types": q_abstract_types,
    "unlabelled_attach": q_unlabelled_attach,
    "mandatory_optional_nodes": q_mandatory_optional_nodes,
    "mandatory_optional_edges": q_mandatory_optional_edges,
    "edge_types_by_rel": q_edge_types_by_rel,
    "edge_types_by_endpoints": q_edge_types_by_endpoints,
    "property_types_nodes": q_property_types_nodes,
    "property_types_edges": q_property_types_edges,
    "property_types_strict": q_property_types_strict,
    "typed_schema": q_typed_schema,
    "degree_stats": q_degree_stats,
    "cardinality": q_cardinality,
    "node_schema": q_node_schema_flagship,
    "ddl_loose": q_ddl_loose,
    "ddl_strict": q_ddl_strict,
    "schema_fields": q_schema_fields,
    "schema_xsd": q_schema_xsd,
    "mapping_rules_reified": _rules("reified"),
    "mapping_rules_link": _rules("link"),
    "node_quads_reified": _node_quads("reified"),
    "node_quads_link": _node_quads("link"),
    "edge_quads_reified": _edge_quads("reified"),
    "edge_quads_link": _edge_quads("link"),
    "rule_quads_reified": _rule_quads("reified"),
    "rule_quads_link": _rule_quads("link"),
    "rules_vs_quads": q_rules_vs_quads,
    "executable_rules": q_executable_rules,
    "rule_classes": q_rule_classes,
    "rule_quads_hashed": q_rule_quads_hashed,
    "iri_policies": q_iri_policies,
    "nquads_lines": q_nquads_lines,
    "iri_modes": q_iri_modes,
    "eval_nodes": q_eval_nodes,
    "assignments_nodes": q_assignments_nodes,
    "majority_labels": q_majority_labels,
    "eval_edges": q_eval_edges,
    "jaccard_pairs": q_jaccard_pairs,
    "jaccard_pairs_props": q_jaccard_pairs_props,
    "jaccard_merge": _jmerge("components"),
    "jaccard_merge_one_hop": _jmerge("one_hop"),
    "schema_merge_nodes": q_schema_merge_nodes,
    "schema_merge_edges": q_schema_merge_edges,
    "label_profile": q_label_profile,
    "edge_profile": q_edge_profile,
    "flatten_props": q_flatten_props,
    "node_types_cluster_granularity": q_node_types_cluster_granularity,
    "node_types_multi": q_node_types_multi,
    "encoded_patterns": q_encoded_patterns,
    "pattern_distance_stats": q_pattern_distance_stats,
    "lsh_params": q_lsh_params,
    "encoded_edge_patterns": q_encoded_edge_patterns,
    "encoded_node_codes": q_encoded_node_codes,
    "lsh_invariants": q_lsh_invariants,
    "node_lsh": q_node_lsh,
    "edge_lsh": q_edge_lsh,
    "lsh_node_types": q_lsh_node_types,
    "csv_round_trip": q_csv_round_trip,
    "csv_round_trip_edges": q_csv_round_trip_edges,
    "csv_bulk_import": q_csv_bulk_import,
    "csv_import_report": q_csv_import_report,
    "csv_import_edges": q_csv_import_edges,
    "csv_bad_edges": q_csv_bad_edges,
    "trig_lines": q_trig_lines,
    "quads_written": q_quads_written,
    "trig_written_link": _trig_written("link"),
    "trig_written_reified": _trig_written("reified"),
    "align_union": q_align_union,
    "node_elements": q_node_elements,
    "edge_elements": q_edge_elements,
    "typed_elements": q_typed_elements,
    "xml_validation": q_xml_validation,
    "xml_chunks": q_xml_chunks,
}
