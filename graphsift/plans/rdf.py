"""Mapping rules and RDF quads (MAP1-2, RDF1-7).

The reference writes XML chunks, generates X3ML / RML documents and runs an
external engine per chunk. Here the two mapping shapes are a rules *table*
derived from the schema fields, which ``plans.rules`` interprets; this module
also computes the same quads straight from the element tables:

* ``link`` (X3ML shape): ``src REL link . link a intermediate .
  link hasTarget dst . link REL_prop "v"`` in the named graph ``custom``;
  nodes get a type, ``rdfs:label`` = id and ``has_<prop>`` literals.
* ``reified`` (RML shape): ``edge a REL ; source S ; target T ; REL_prop "v"``;
  nodes get a type and ``has_<prop>`` literals.

IRIs: a node is ``{ns}{label set}/{id}`` (``Node`` when unlabelled), so an
edge's endpoint IRIs follow from the labels it already carries. Node quads join the pattern -> type table once
(pattern-level, broadcast only when its row count is under a checked bound).
Blank values produce no triple.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsift.functions.text import iri_segment, label_key, nquad_literal
from graphsift.functions.typing import xsd_type
from graphsift.operators.joins import broadcast_if_small
from graphsift.operators.patterns import NODE_KEY, with_node_key
from graphsift.plans.ddl import type_names_of
from graphsift.plans.discovery import GraphSchema
from graphsift.session import cut_lineage
from graphsift.sources.graph import as_often, attach_to_ends

# ---- fixed values: vocabulary ----------------------------------------------------
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
XSD_NS = "http://www.w3.org/2001/XMLSchema#"
DEFAULT_BASE = "https://example.org/"
LINK_GRAPH = "custom"
UNLABELLED_SEGMENT = "Node"
# ----------------------------------------------------------------------------------

def namespace(base: str, shape: str) -> str:
    return base + ("custom/" if shape == "link" else "")


def _graph(base: str, shape: str) -> Column:
    return F.lit(base + LINK_GRAPH) if shape == "link" else F.lit(None).cast("string")


def node_segment(labels_key_col: Column) -> Column:
    return F.when(labels_key_col == "", F.lit(UNLABELLED_SEGMENT)).otherwise(iri_segment(labels_key_col))


def node_iri(ns: str, labels_key_col: Column, node_id: Column) -> Column:
    return F.concat(F.lit(ns), node_segment(labels_key_col), F.lit("/"), node_id.cast("string"))


def type_names(schema: GraphSchema) -> DataFrame:
    """(type_id, type_name): names of the node types, as in the XSD."""
    return type_names_of(schema.node_types)


# ------------------------------------------------------------------- mapping rules

def mapping_rules(fields: DataFrame, shape: str = "reified", base: str = DEFAULT_BASE,
                  types: DataFrame | None = None) -> DataFrame:
    """MAP1/MAP2: rules table (type_name, kind, rule, predicate, template, field).

    ``template`` uses ``{id}``, ``{src}``, ``{dst}`` and ``{value}`` holes.
    ``types`` (type_name, kind) names further types, those without any field.
    ``plans.rules`` makes these rows executable and applies them.
    """
    ns = namespace(base, shape)
    kinds = fields.select("type_name", "kind")
    if types is not None:
        kinds = kinds.unionByName(types.select("type_name", "kind"))
    kinds = kinds.distinct()
    T = iri_segment("type_name")

    def row(rule, predicate, template, field=None):
        return (F.lit(rule).alias("rule"), predicate.alias("predicate"), template.alias("template"),
                (field if field is not None else F.lit(None).cast("string")).alias("field"))

    subj = kinds.select("type_name", "kind", *row(
        "subject", F.lit(None).cast("string"), F.concat(F.lit(ns), T, F.lit("/{id}"))))
    cls = kinds.select("type_name", "kind", *row(
        "class", F.lit(RDF_TYPE),
        F.when((F.col("kind") == "edge") & F.lit(shape == "link"), F.lit(ns + "intermediate"))
        .otherwise(F.concat(F.lit(ns), T))))
    out = subj.unionByName(cls)
    if shape == "link":
        out = out.unionByName(kinds.where("kind = 'node'").select(
            "type_name", "kind", *row("label", F.lit(RDFS_LABEL), F.lit("{id}"))))
    props = fields.where("role = 'property'")
    pred = F.when(F.col("kind") == "node", F.concat(F.lit(ns + "has_"), iri_segment("field"))) \
        .otherwise(F.concat(F.lit(ns), T, F.lit("_"), iri_segment("field")))
    out = out.unionByName(props.select("type_name", "kind", *row(
        "literal", pred, F.lit("{value}"), F.col("field"))))
    # endpoint rules use the first source / target type, as the mapping documents do
    ends = (fields.where("role <> 'property'").groupBy("type_name", "role")
            .agg(F.min("xsd_type").alias("end_type")))
    if shape == "link":
        out = out.unionByName(ends.where("role = 'source'").select(
            "type_name", F.lit("edge").alias("kind"), *row(
                "link", F.concat(F.lit(ns), T), F.concat(F.lit(ns), iri_segment("end_type"), F.lit("/{src}")))))
        out = out.unionByName(ends.where("role = 'target'").select(
            "type_name", F.lit("edge").alias("kind"), *row(
                "has_target", F.lit(ns + "hasTarget"),
                F.concat(F.lit(ns), iri_segment("end_type"), F.lit("/{dst}")))))
    else:
        out = out.unionByName(ends.select(
            "type_name", F.lit("edge").alias("kind"), *row(
                F.col("role"), F.concat(F.lit(ns), F.col("role")),
                F.concat(F.lit(ns), iri_segment("end_type"),
                         F.when(F.col("role") == "source", F.lit("/{src}")).otherwise(F.lit("/{dst}"))))))
    return out


# ------------------------------------------------------------------------- quads

QUAD_COLUMNS = ["graph", "subject", "predicate", "object", "object_kind", "datatype"]


# Structural entries ride in the same map as the properties, under keys that
# start with a control character (never a property name), so one ``explode``
# of one ``map_concat`` yields every quad of an element and the projection
# stays in whole-stage codegen (no lambda functions per row).
_K = "\u0001"


def _explode_quads(df: DataFrame, structural: dict[str, Column], subject: Column,
                   subject_of: dict[str, Column], predicate_of: dict[str, Column],
                   literal_prefix: Column, graph: Column, kinds: dict[str, str]) -> DataFrame:
    smap = F.create_map(*[x for k, v in structural.items() for x in (F.lit(_K + k), v)])
    exploded = df.select("*", F.explode(F.map_concat(smap, F.col("props"))).alias("_k", "_v"))
    is_struct = F.col("_k").startswith(_K)
    pred = F.concat(literal_prefix, iri_segment("_k"))
    subj = subject
    kind = F.lit("literal")
    for k in structural:
        hit = F.col("_k") == F.lit(_K + k)
        pred = F.when(hit, predicate_of[k]).otherwise(pred)
        if k in subject_of:
            subj = F.when(hit, subject_of[k]).otherwise(subj)
        kind = F.when(hit, F.lit(kinds.get(k, "iri"))).otherwise(kind)
    return (exploded.where(is_struct | (F.trim(F.col("_v")) != ""))
            .select(graph.alias("graph"), subj.alias("subject"), pred.alias("predicate"),
                    F.col("_v").alias("object"), kind.alias("object_kind"),
                    F.when(~is_struct, F.col("_k")).alias("_prop")))


def _finish(q: DataFrame, prop_types: DataFrame | None) -> DataFrame:
    """Drop the helper column; with ``prop_types`` attach xsd datatypes to literals."""
    if prop_types is None:
        return q.select(*QUAD_COLUMNS[:-1], F.lit(None).cast("string").alias("datatype"))
    dt = prop_types.select(F.col("property").alias("_prop"), F.concat(
        F.lit(XSD_NS), F.substring_index(xsd_type(F.col("type")), ":", -1)).alias("datatype"))
    return q.join(broadcast_if_small(dt), "_prop", "left").select(*QUAD_COLUMNS)


def node_quads(nodes: DataFrame, schema: GraphSchema, shape: str = "reified",
               base: str = DEFAULT_BASE, typed: bool = False) -> DataFrame:
    """RDF1: type, (label), one literal per non-blank property, per node."""
    ns = namespace(base, shape)
    g = _graph(base, shape)
    names = cut_lineage(schema.node_pattern_types.join(type_names(schema), "type_id")
                        .select(*NODE_KEY, "type_name"))
    keyed = with_node_key(nodes).join(broadcast_if_small(names), NODE_KEY)
    s = node_iri(ns, F.col("labels_key"), F.col("node_id"))
    structural = {"type": F.concat(F.lit(ns), iri_segment("type_name"))}
    preds = {"type": F.lit(RDF_TYPE)}
    kinds = {"type": "iri"}
    if shape == "link":
        structural["label"] = F.col("node_id").cast("string")
        preds["label"] = F.lit(RDFS_LABEL)
        kinds["label"] = "literal"
    q = _explode_quads(keyed, structural, s, {}, preds, F.lit(ns + "has_"), g, kinds)
    return _finish(q, schema.node_prop_types if typed else None)


def edge_quads(edges: DataFrame, shape: str = "reified", base: str = DEFAULT_BASE,
               prop_types: DataFrame | None = None) -> DataFrame:
    """RDF2/RDF3: edge quads from each edge's own type and endpoint labels
    (:func:`raw_edge_quads` where edges have no labels yet).

    A narrow transform (one explode + projection): no join, no shuffle (unless
    typed literals are asked for, which adds one size-checked vocabulary join).
    """
    src, dst = (node_segment(label_key(c)) for c in ("src_labels", "dst_labels"))
    return _finish(_edge_quads(edges, src, dst, shape, base), prop_types)


def raw_edge_quads(raw_edges: DataFrame, nodes: DataFrame, shape: str = "reified", base: str = DEFAULT_BASE,
                   prop_types: DataFrame | None = None) -> DataFrame:
    """The quads of :func:`edge_quads` for edges that ``nodes`` label. A literal needs
    the relation type and the edge's id alone, so no value rides the label joins, and
    IRI segments of label sets are made once per node."""
    narrow = attach_to_ends(raw_edges, nodes, node_segment(label_key("labels")), "segment", UNLABELLED_SEGMENT)
    ends = _edge_quads(narrow.withColumn("props", F.create_map().cast("map<string,string>")),
                       F.col("src_segment"), F.col("dst_segment"), shape, base)
    ns = namespace(base, shape)
    rel = iri_segment("rel_type")
    values = as_often(raw_edges, nodes).select(
        F.concat(F.lit(ns), rel, F.lit("/"), iri_segment("edge_id")).alias("subject"),
        F.concat(F.lit(ns), rel, F.lit("_")).alias("_prefix"), F.explode("props").alias("_prop", "object"))
    literals = values.where(F.trim("object") != "").select(
        _graph(base, shape).alias("graph"), "subject", F.concat("_prefix", iri_segment("_prop")).alias("predicate"), "object",
        F.lit("literal").alias("object_kind"), "_prop")
    return _finish(ends.unionByName(literals), prop_types)


def _edge_quads(edges: DataFrame, src_segment: Column, dst_segment: Column, shape: str, base: str) -> DataFrame:
    ns = namespace(base, shape)
    g = _graph(base, shape)
    rel = iri_segment("rel_type")
    src, dst = (F.concat(F.lit(ns), segment, F.lit("/"), F.col(c).cast("string"))
                for segment, c in ((src_segment, "src_id"), (dst_segment, "dst_id")))
    e = F.concat(F.lit(ns), rel, F.lit("/"), iri_segment("edge_id"))
    df = edges.select("props", rel.alias("_rel"), src.alias("_src"), dst.alias("_dst"), e.alias("_e"))
    rel_c, src_c, dst_c, e_c = F.col("_rel"), F.col("_src"), F.col("_dst"), F.col("_e")
    lit_prefix = F.concat(F.lit(ns), rel_c, F.lit("_"))
    if shape == "link":
        structural = {"link": e_c, "type": F.lit(ns + "intermediate"), "target": dst_c}
        preds = {"link": F.concat(F.lit(ns), rel_c), "type": F.lit(RDF_TYPE),
                 "target": F.lit(ns + "hasTarget")}
        subjects = {"link": src_c}
    elif shape == "reified":
        structural = {"type": F.concat(F.lit(ns), rel_c), "source": src_c, "target": dst_c}
        preds = {"type": F.lit(RDF_TYPE), "source": F.lit(ns + "source"), "target": F.lit(ns + "target")}
        subjects = {}
    else:
        raise ValueError(f"unknown shape {shape!r}")
    return _explode_quads(df, structural, e_c, subjects, preds, lit_prefix, g, {})


def _term(c: str, kind_col: str = "object_kind") -> Column:
    return F.when(F.col(kind_col) == "iri", F.concat(F.lit("<"), F.col(c), F.lit(">"))) \
        .otherwise(F.concat(nquad_literal(F.col(c)),
                            F.when(F.col("datatype").isNotNull(),
                                   F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">")))
                            .otherwise(F.lit(""))))


def _triple(q: DataFrame) -> Column:
    return F.concat(F.lit("<"), F.col("subject"), F.lit("> <"), F.col("predicate"), F.lit("> "),
                    _term("object"))


def nquads_lines(quads: DataFrame) -> DataFrame:
    """RDF5: one N-Quads line per quad (literals escaped, optional datatype)."""
    g = F.when(F.col("graph").isNotNull(), F.concat(F.lit(" <"), F.col("graph"), F.lit(">"))) \
        .otherwise(F.lit(""))
    return quads.select(F.concat(_triple(quads), g, F.lit(" .")).alias("line"))


def trig_lines(quads: DataFrame) -> DataFrame:
    """RDF5/6 TriG: each line is a self-contained graph block ``<g> { s p o . }``.

    Valid TriG that every task can write independently (no regrouping of a
    graph's triples into one task).
    """
    g = F.when(F.col("graph").isNotNull(), F.concat(F.lit("<"), F.col("graph"), F.lit("> ")))\
        .otherwise(F.lit(""))
    return quads.select(F.concat(g, F.lit("{ "), _triple(quads), F.lit(" . }")).alias("line"))


def write_quads(quads: DataFrame, path: str, fmt: str = "nquads", max_records: int | None = None,
                compression: str | None = None) -> None:
    """Write quads as N-Quads or TriG text, one file per partition;
    ``max_records`` caps the lines per file (the reference's chunking).
    ``compression`` (``gzip``) as in Spark's text files."""
    lines = nquads_lines(quads) if fmt == "nquads" else trig_lines(quads)
    w = lines.write.mode("overwrite")
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    w.text(path, compression=compression)
