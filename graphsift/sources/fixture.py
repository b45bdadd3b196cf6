"""Property graph over the driver's TPC-H-ish tables (see FIXTURES.md).

Eight node tables and six edge kinds, with irregular label sets and missing
properties on purpose. All expressions are deterministic and have a direct
DuckDB counterpart (``oracles.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsift.sources.graph import EdgeSpec, NodeSpec, read_edges, read_nodes

# ---- fixed values: kind of each source table; a node id is key * 16 + kind ----
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER, DOCUMENT, GRADE = range(1, 9)
# Table label by kind: the evaluation ground truth.
TRUTH_LABELS = ["Region", "Nation", "Customer", "Supplier", "Part", "Order", "Document", "Grade"]
# ------------------------------------------------------------------------------


def _key(c: str) -> str:
    """Ids of different tables never meet, however many rows the tables have."""
    return f"{c} * 16"


def _money(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS STRING)"


def _day(c: str) -> str:
    return f"date_format({c}, 'yyyy-MM-dd')"


_READ_CACHE: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet relation of one driver table, reused per session (the file
    listing and footer read happen once, like a catalog table)."""
    key = (id(spark), sf_dir, name)
    hit = _READ_CACHE.get(key)
    if hit is None or hit.sparkSession is not spark:
        hit = _READ_CACHE[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return hit


def _reader(sf_dir: str, name: str):
    def load(spark: SparkSession) -> DataFrame:
        return table(spark, sf_dir, name)
    return load


def node_specs(sf_dir: str) -> list[NodeSpec]:
    cust_labels = ("CASE WHEN c_custkey % 10 = 3 THEN CAST(array() AS ARRAY<STRING>) "
                   "WHEN c_acctbal > 9000 THEN array('Customer', 'Premium') ELSE array('Customer') END")
    order_labels = ("CASE WHEN o_orderkey % 20 = 7 THEN CAST(array() AS ARRAY<STRING>) "
                    "ELSE array('Order') END")
    return [
        NodeSpec(_reader(sf_dir, "region"), _key("r_regionkey"), ["Region"], {"name": "r_name"},
                 REGION),
        NodeSpec(_reader(sf_dir, "nation"), _key("n_nationkey"), ["Nation"], {"name": "n_name"},
                 NATION),
        NodeSpec(_reader(sf_dir, "customer"), _key("c_custkey"), cust_labels,
                 {"name": "c_name", "acctbal": _money("c_acctbal"),
                  "mktsegment": "CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END"},
                 CUSTOMER),
        NodeSpec(_reader(sf_dir, "supplier"), _key("s_suppkey"), ["Supplier"],
                 {"name": "s_name", "acctbal": _money("s_acctbal")}, SUPPLIER),
        NodeSpec(_reader(sf_dir, "part"), _key("p_partkey"), ["Part"],
                 {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size",
                  "retailprice": _money("p_retailprice")}, PART),
        NodeSpec(_reader(sf_dir, "orders"), _key("o_orderkey"), order_labels,
                 {"status": "o_orderstatus", "totalprice": _money("o_totalprice"),
                  "orderdate": _day("o_orderdate"),
                  "orderpriority": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END"},
                 ORDER),
        NodeSpec(_reader(sf_dir, "documents"), _key("doc_id"), ["Document"],
                 {"lang": "lang", "source": "source", "n_chars": "n_chars", "text": "text"}, DOCUMENT),
        NodeSpec(_reader(sf_dir, "labels"), _key("doc_id"), ["Grade"],
                 {"quality": "quality",
                  "toxic": "CASE WHEN toxic = 1 THEN 'true' WHEN toxic IS NOT NULL THEN 'false' END"},
                 GRADE),
    ]


def edge_specs(sf_dir: str) -> list[EdgeSpec]:
    li_id = ("concat('CONTAINS_', concat_ws('_', l_orderkey, l_partkey, l_suppkey, l_linenumber, "
             + _day("l_shipdate") + "))")
    return [
        EdgeSpec(_reader(sf_dir, "nation"), "IN_REGION", _key("n_nationkey"), _key("n_regionkey"),
                 src_offset=NATION, dst_offset=REGION),
        EdgeSpec(_reader(sf_dir, "customer"), "IN_NATION", _key("c_custkey"), _key("c_nationkey"),
                 src_offset=CUSTOMER, dst_offset=NATION),
        EdgeSpec(_reader(sf_dir, "supplier"), "IN_NATION", _key("s_suppkey"), _key("s_nationkey"),
                 src_offset=SUPPLIER, dst_offset=NATION),
        EdgeSpec(_reader(sf_dir, "orders"), "PLACED", _key("o_custkey"), _key("o_orderkey"),
                 {"orderdate": _day("o_orderdate")}, src_offset=CUSTOMER, dst_offset=ORDER),
        EdgeSpec(_reader(sf_dir, "lineitem"), "CONTAINS", _key("l_orderkey"), _key("l_partkey"),
                 {"quantity": _money("l_quantity"), "linenumber": "l_linenumber",
                  "shipdate": _day("l_shipdate"),
                  "returnflag": "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END"},
                 src_offset=ORDER, dst_offset=PART, edge_id=li_id),
        EdgeSpec(_reader(sf_dir, "lineitem"), "SUPPLIES", _key("l_suppkey"), _key("l_partkey"),
                 src_offset=SUPPLIER, dst_offset=PART, distinct=True),
        EdgeSpec(_reader(sf_dir, "labels"), "GRADED", _key("doc_id"), _key("doc_id"),
                 src_offset=DOCUMENT, dst_offset=GRADE),
    ]


def fixture_graph(spark: SparkSession, sf_dir: str, values: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the fixture graph over ``sf_dir``; without ``values``
    the property maps hold names alone."""
    nodes = read_nodes(spark, node_specs(sf_dir), values)
    edges = read_edges(spark, edge_specs(sf_dir), nodes, values)
    return nodes, edges


def fixture_raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture edges without endpoint labels (no node joins)."""
    return read_edges(spark, edge_specs(sf_dir), None)


def truth_label(node_id: Column) -> Column:
    """Ground-truth table label of a fixture node id."""
    return F.element_at(F.array(*[F.lit(x) for x in TRUTH_LABELS]), (node_id % 16).cast("int"))

