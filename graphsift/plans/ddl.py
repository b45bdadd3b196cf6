"""Schema sinks: PG-Schema DDL (LOOSE / STRICT) and XSD (SNK1-8).

Each output is a DataFrame of text lines ``(section, ord, line)`` built with
column expressions from the type tables; rendering to a file is an ordered
``coalesce(1).write.text`` of a type-level table (tens to thousands of rows),
so no element-level data ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsift.functions.sets import is_abstract
from graphsift.functions.text import safe_name
from graphsift.functions.typing import pg_type, xsd_type
from graphsift.operators.joins import broadcast_if_small
from graphsift.operators.numbering import dense_number
from graphsift.plans.discovery import GraphSchema
from graphsift.session import cut_lineage

# ---- fixed values: property names never written to a schema ------------------
DDL_IGNORED = ["original_label", "labelArray", "labelVector", "features", "prop_original_label"]
XSD_IGNORED = ["original_label", "original_data"]
GRAPH_NAME = "NewGraphSchema"
# -------------------------------------------------------------------------------


def _keep(p, ignored) -> Column:
    return ~p["name"].contains(":") & ~p["name"].isin(ignored)


def _prop_items(typed: str, prefix: str = "") -> Column:
    return F.transform(F.filter(typed, lambda p: _keep(p, DDL_IGNORED)),
                       lambda p: F.concat(F.lit(prefix), p["name"], F.lit(" "), pg_type(p["type"])))


def _props_block(strict: bool) -> Column:
    items = F.concat(_prop_items("mandatory_typed"),
                     _prop_items("optional_typed", "OPTIONAL " if strict else ""))
    return F.when(F.size(items) > 0, F.concat(F.lit(" {"), F.array_join(items, ", "), F.lit("}"))) \
        .otherwise(F.lit(""))


def _endpoint(labels: str, abstract_name: str) -> Column:
    return F.when(is_abstract(F.col(labels)), F.lit(abstract_name)).otherwise(
        F.array_join(F.transform(labels, lambda x: F.concat(x, F.lit("Type"))), "|"))


def _line(section: int, ord_col, text) -> list[Column]:
    return [F.lit(section).alias("section"), ord_col.alias("ord"), text.alias("line")]


def _numbers(names: DataFrame, col: str, number: str) -> DataFrame:
    """(col, number): 1..k in the order of ``col``, numbered over range partitions."""
    placed = dense_number(names.select(col), [col], pos="at")
    return placed.select(F.col(col).alias(f"{number}_of"), (F.col("at") + 1).alias(number))


def _numbered_abstract(nodes: DataFrame) -> DataFrame:
    """Number abstract node types 1..k by type id."""
    numbers = _numbers(nodes.where("is_abstract"), "type_id", "abs_no")
    return nodes.join(numbers, F.col("type_id") == F.col("abs_no_of"), "left").drop("abs_no_of")


def type_names_of(node_types: DataFrame) -> DataFrame:
    """(type_id, type_name): first label set made XML-safe, or UNKNOWN_n. Names
    are unique: of types that would share one, all but the first (by type id)
    get a digest of their type id appended."""
    numbered = _numbered_abstract(node_types.select("type_id", "is_abstract", "labels"))
    named = numbered.select("type_id", F.when(F.col("is_abstract"), F.concat(F.lit("UNKNOWN_"), F.col("abs_no")))
                            .otherwise(safe_name(F.element_at("labels", 1))).alias("name"))
    first = named.groupBy(F.col("name").alias("n")).agg(F.min("type_id").alias("first"))
    return named.join(first, F.col("name") == F.col("n")).select("type_id", F.when(
        F.col("type_id") == F.col("first"), F.col("name")).otherwise(
            F.concat("name", F.lit("_"), F.substring(F.sha2("type_id", 256), 1, 8))).alias("type_name"))


def schema_ddl(schema: GraphSchema, mode: str = "strict") -> DataFrame:
    """PG-Schema DDL lines as a DataFrame (section, ord, line)."""
    nodes = schema.typed_node_types()
    edges = schema.typed_edge_types()
    spark = nodes.sparkSession
    needs = edges.agg(F.coalesce(F.max(is_abstract(F.col("src_labels")).cast("int")), F.lit(0)).alias("s"),
                      F.coalesce(F.max(is_abstract(F.col("dst_labels")).cast("int")), F.lit(0)).alias("d"))
    type_name = F.when(F.col("is_abstract"), F.lit("AbstractType")).otherwise(
        F.concat(F.array_join("labels", "_"), F.lit("Type")))
    node_ord = F.col("type_id")
    if mode == "loose":
        label = F.when(F.col("is_abstract"), F.lit("Abstract")).otherwise(F.array_join("labels", " | "))
        node_lines = nodes.select(*_line(1, node_ord, F.concat(
            F.lit("  ("), type_name, F.lit(": "), label, _props_block(False), F.lit("),"))))
        rel_name = F.concat(F.array_join("rel_types", "_"), F.lit("Type"))
        edge_lines = edges.select(*_line(3, F.col("type_id"), F.concat(
            F.lit("  (:"), _endpoint("src_labels", "ABSTRACT_SRC"), F.lit(")-["), rel_name, F.lit(": "),
            F.array_join("rel_types", " | "), _props_block(False), F.lit("]->(:"),
            _endpoint("dst_labels", "ABSTRACT_DST"), F.lit("),"))))
        ends = needs.select(F.explode(F.array(
            F.when(F.col("s") == 1, F.struct(F.lit("a").alias("o"), F.lit("  (ABSTRACT_SRC: OPEN),").alias("l"))),
            F.when(F.col("d") == 1, F.struct(F.lit("b").alias("o"), F.lit("  (ABSTRACT_DST: OPEN),").alias("l")))))
            .alias("e")).where(F.col("e").isNotNull()).select(*_line(2, F.col("e.o"), F.col("e.l")))
        fixed = spark.createDataFrame(
            [(0, "", f"CREATE GRAPH TYPE {GRAPH_NAME} LOOSE {{"), (9, "", "}")],
            "section int, ord string, line string")
        return fixed.unionByName(node_lines).unionByName(ends).unionByName(edge_lines)
    if mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")

    nodes = _numbered_abstract(nodes)
    strict_name = F.when(F.col("is_abstract"), F.concat(F.lit("AbstractType_"), F.col("abs_no"))) \
        .otherwise(type_name)
    strict_label = F.when(F.col("is_abstract"), F.concat(F.lit("ABSTRACT_"), F.col("abs_no"))) \
        .otherwise(F.array_join("labels", " | "))
    node_lines = nodes.select(*_line(1, node_ord, F.concat(
        F.lit("CREATE NODE TYPE "), strict_name, F.lit(" : "), strict_label, _props_block(True), F.lit(";"))))
    ends = needs.select(F.explode(F.array(
        F.when(F.col("s") == 1, F.struct(F.lit("a").alias("o"), F.lit("CREATE NODE TYPE ABSTRACT_SRC : OPEN;").alias("l"),
                                         F.lit("  (ABSTRACT_SRC),").alias("g"))),
        F.when(F.col("d") == 1, F.struct(F.lit("b").alias("o"), F.lit("CREATE NODE TYPE ABSTRACT_DST : OPEN;").alias("l"),
                                         F.lit("  (ABSTRACT_DST),").alias("g")))))
        .alias("e")).where(F.col("e").isNotNull())
    rel_name = F.when(F.size("rel_types") == 0, F.lit("AbstractEdgeType")).otherwise(
        F.concat(F.lower(F.array_join("rel_types", "_")), F.lit("Type")))
    rel_label = F.when(F.size("rel_types") == 0, F.lit("ABSTRACT_EDGE")).otherwise(
        F.array_join("rel_types", " | "))
    edge_lines = edges.select(*_line(5, F.col("type_id"), F.concat(
        F.lit("CREATE EDGE TYPE "), rel_name, F.lit(" : "), rel_label, _props_block(True), F.lit(";"))))
    graph_nodes = nodes.select(*_line(7, node_ord, F.concat(F.lit("  ("), strict_name, F.lit("),"))))
    src, dst = _endpoint("src_labels", "ABSTRACT_SRC"), _endpoint("dst_labels", "ABSTRACT_DST")
    graph_edges = edges.select(*_line(9, F.col("type_id"), F.concat(
        F.lit("  (:"), src, F.lit(")-["), rel_name, F.lit("]->(:"), dst, F.lit("),"))))
    card = F.col("cardinality")
    constraint = (
        F.when(card == "1:1", F.concat(F.lit("  FOR (x:"), src, F.lit(") SINGLETON x,y WITHIN (x)-[y: "),
                                       rel_name, F.lit("]->(:"), dst, F.lit(")")))
        .when(card == "N:1", F.concat(F.lit("  FOR (x:"), src, F.lit(") SINGLETON y WITHIN (x)-[y: "),
                                      rel_name, F.lit("]->(:"), dst, F.lit(")")))
        .when(card == "1:N", F.concat(F.lit("  FOR (x:"), dst, F.lit(") SINGLETON x WITHIN (:"), src,
                                      F.lit(")-[y: "), rel_name, F.lit("]->(x)"))))
    constraints = edges.select(*_line(10, F.col("type_id"), constraint)).where(F.col("line").isNotNull())
    fixed = spark.createDataFrame(
        [(0, "", "-- NODE TYPES --"), (3, "", ""), (4, "", "-- EDGE TYPES --"), (6, "", ""),
         (6, "z", f"CREATE GRAPH TYPE {GRAPH_NAME} STRICT {{"), (11, "", "}")],
        "section int, ord string, line string")
    return (fixed.unionByName(node_lines)
            .unionByName(ends.select(*_line(2, F.col("e.o"), F.col("e.l"))))
            .unionByName(edge_lines).unionByName(graph_nodes)
            .unionByName(ends.select(*_line(8, F.col("e.o"), F.col("e.g"))))
            .unionByName(graph_edges).unionByName(constraints))


# ------------------------------------------------------------------------------ XSD

def schema_fields(schema: GraphSchema) -> DataFrame:
    """SNK5/6: XSD structure as rows (type_name, kind, role, field, xsd_type, min_occurs).

    Node types are named by :func:`type_names_of` (``UNKNOWN_n`` when unlabelled);
    edge types by their first relation type, grouping types that share it.
    Names are made XML-safe (``A:B`` -> ``A_B``). ``min_occurs`` is 1 only
    for properties mandatory under their exact name.
    """
    names = broadcast_if_small(cut_lineage(type_names_of(schema.node_types)))
    nodes = schema.typed_node_types().join(names, "type_id")
    nf = []
    for col, occ in (("mandatory_typed", 1), ("optional_typed", 0)):
        nf.append(nodes.select("type_name", F.explode(col).alias("p"))
                  .where(_keep(F.col("p"), XSD_IGNORED) & ~F.col("p.name").contains("original_data"))
                  .select("type_name", F.lit("node").alias("kind"), F.lit("property").alias("role"),
                          F.col("p.name").alias("field"), xsd_type(F.col("p.type")).alias("xsd_type"),
                          F.lit(occ).alias("min_occurs")))
    edges = schema.typed_edge_types().withColumn(
        "type_name", F.coalesce(safe_name(F.element_at("rel_types", 1)), F.lit("UnknownEdge")))
    ef = []
    for col, occ in (("mandatory_typed", 1), ("optional_typed", 0)):
        ef.append(edges.select("type_name", F.explode(col).alias("p"))
                  .where(_keep(F.col("p"), []))
                  .select("type_name", F.col("p.name").alias("field"),
                          xsd_type(F.col("p.type")).alias("xsd_type"), F.lit(occ).alias("min_occurs")))
    eprops = (ef[0].unionByName(ef[1]).groupBy("type_name", "field")
              .agg(F.max("min_occurs").alias("min_occurs"), F.min("xsd_type").alias("xsd_type"))
              .select("type_name", F.lit("edge").alias("kind"), F.lit("property").alias("role"),
                      "field", "xsd_type", "min_occurs"))
    ends = []
    for role, col, abstract in (("source", "src_labels", "ABSTRACT_SRC"),
                                ("target", "dst_labels", "ABSTRACT_DST")):
        per = edges.groupBy("type_name").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(col)))).alias("ls"))
        per = cut_lineage(per)
        numbers = _numbers(per.where(F.size("ls") == 0), "type_name", "k")
        per = per.join(numbers, F.col("type_name") == F.col("k_of"), "left")
        ends.append(per.select("type_name", F.explode(
            F.when(F.size("ls") > 0, F.transform("ls", lambda x: safe_name(x)))
            .otherwise(F.array(F.concat(F.lit(abstract), F.col("k"))))).alias("xsd_type"))
            .select("type_name", F.lit("edge").alias("kind"), F.lit(role).alias("role"),
                    F.lit(role).alias("field"), "xsd_type", F.lit(1).alias("min_occurs")))
    return (nf[0].unionByName(nf[1]).unionByName(eprops)
            .unionByName(ends[0]).unionByName(ends[1]))


def schema_xsd(fields: DataFrame) -> DataFrame:
    """Render XSD text lines (section, ord, line) from :func:`schema_fields`."""
    spark = fields.sparkSession
    elem = F.concat(F.lit('      <xs:element name="'), F.col("field"), F.lit('" type="'), F.col("xsd_type"),
                    F.lit('" minOccurs="'), F.col("min_occurs").cast("string"),
                    F.lit('" maxOccurs="1"/>'))
    choice_elem = F.concat(F.lit('        <xs:element name="'), F.col("role"), F.lit('" type="'),
                           F.col("xsd_type"), F.lit('"/>'))
    body = fields.select(
        "type_name", "kind",
        F.when(F.col("role") == "property", F.lit(3)).when(F.col("role") == "source", F.lit(1))
        .otherwise(F.lit(2)).alias("part"),
        F.concat_ws("|", "field", "xsd_type").alias("o2"),
        F.when(F.col("role") == "property", elem).otherwise(choice_elem).alias("line"))
    kinds = fields.select("type_name", "kind").distinct()
    head = kinds.select("type_name", "kind", F.lit(0).alias("part"), F.lit("").alias("o2"), F.concat(
        F.lit('  <xs:complexType name="'), F.col("type_name"), F.lit('">\n'),
        F.lit("    <xs:annotation><xs:appinfo><type>"), F.col("kind"),
        F.lit("</type></xs:appinfo></xs:annotation>\n    <xs:sequence>")).alias("line"))
    opens = kinds.where("kind = 'edge'").select(
        "type_name", "kind", F.explode(F.array(
            F.struct(F.lit(1).alias("p"), F.lit("").alias("o")),
            F.struct(F.lit(2).alias("p"), F.lit("").alias("o")))).alias("c"))
    choice_open = opens.select("type_name", "kind", F.col("c.p").alias("part"), F.lit("!").alias("o2"),
                               F.lit('      <xs:choice minOccurs="1" maxOccurs="1">').alias("line"))
    choice_close = opens.select("type_name", "kind", F.col("c.p").alias("part"), F.lit("~").alias("o2"),
                                F.lit("      </xs:choice>").alias("line"))
    tail = kinds.select("type_name", "kind", F.lit(4).alias("part"), F.lit("").alias("o2"), F.lit(
        '    </xs:sequence>\n    <xs:attribute name="id" type="xs:ID" use="required"/>\n'
        '    <xs:attribute name="label" type="xs:string"/>\n  </xs:complexType>').alias("line"))
    types = head.unionByName(choice_open).unionByName(body).unionByName(choice_close).unionByName(tail)
    types = types.select(F.lit(1).alias("section"),
                         F.concat_ws("\u0001", F.when(F.col("kind") == "node", "0").otherwise("1"),
                                     "type_name", F.col("part").cast("string"), "o2").alias("ord"),
                         "line")
    fixed = spark.createDataFrame(
        [(0, "", '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" name="NewGraphSchema">'),
         (2, "", "</xs:schema>")], "section int, ord string, line string")
    return fixed.unionByName(types)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write an ordered line table as one text file (type-level data only)."""
    (lines.orderBy("section", "ord").select("line").coalesce(1)
     .write.mode("overwrite").text(path))


def render(lines: DataFrame) -> str:
    """Ordered text of a line table (schema-sized)."""
    return "\n".join(r["line"] for r in lines.orderBy("section", "ord", "line").collect())
