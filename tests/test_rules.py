"""Rule interpreter and IRI policies on small frames; dense numbering."""

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphsift.operators.numbering import dense_number
from graphsift.plans import policies, rdf
from graphsift.plans.discovery import discover_schema
from graphsift.plans.rules import executable_rules, rule_quads

NODES = [(1, ["A", "B"], {"name": "x", "n": "1"}), (2, ["A_B"], {"name": "y z", "n": "2"}), (3, [], {"odd": "7"}),
         (4, ["Ünï cöde"], {"a b/c": "v", "blank": "  "}), (5, ["Bare"], {}), (6, ["A", "B"], {"name": "\"q\""})]
EDGES = [("e1", 1, 2, "KNOWS", ["A", "B"], ["A_B"], {"since": "2020"}), ("e1", 1, 2, "KNOWS", ["A", "B"], ["A_B"], {}),
         ("e 2", 3, 5, "KNOWS", [], ["Bare"], {"since": "2021", "w": "0.5"}), ("e3", 4, 99, "LIKES", ["Ünï cöde"], [], {})]


@pytest.fixture(scope="module")
def small(spark, make_graph):
    nodes, edges = make_graph(NODES, EDGES)
    return nodes, edges, discover_schema(nodes, edges)


def raw(edges):
    return edges.drop("src_labels", "dst_labels")


def rows(df):
    return sorted(map(str, df.select(*rdf.QUAD_COLUMNS).collect()))


@pytest.mark.parametrize("shape", ["link", "reified"])
def test_rules_give_the_direct_quads(small, shape):
    nodes, edges, schema = small
    got = rule_quads(nodes, raw(edges), schema, executable_rules(schema, shape), shape=shape)
    direct = rdf.node_quads(nodes, schema, shape).unionByName(rdf.edge_quads(edges, shape))
    assert rows(got) == rows(direct)


def test_types_that_share_a_safe_name_have_names_of_their_own(small):
    nodes, _, schema = small
    names = dict(rdf.type_names(schema).collect())
    assert names["A:B"] == "A_B" and names["A_B"].startswith("A_B_") and len(set(names.values())) == len(names)
    quads = rule_quads(nodes, None, schema, executable_rules(schema)).where(F.col("predicate") == rdf.RDF_TYPE)
    classes = {r.subject.rsplit("/", 1)[1]: r.object for r in quads.collect()}
    assert classes["1"] == classes["6"] != classes["2"]


def test_one_class_per_label_and_typed_literals(small):
    nodes, edges, schema = small
    quads = rule_quads(nodes, raw(edges), schema, executable_rules(schema, classes="labels", typed=True)).collect()
    of = {}
    for q in quads:
        if q.predicate == rdf.RDF_TYPE:
            of.setdefault(q.subject.rsplit("/", 1)[1], set()).add(q.object.rsplit("/", 1)[1])
    assert of["1"] == {"A", "B"} and of["2"] == {"A_B"} and of["4"] == {"%C3%9Cn%C3%AF%20c%C3%B6de"}
    assert of["3"] == {"UNKNOWN_1"} and of["e1"] == {"KNOWS"}
    kinds = {q.predicate.rsplit("/", 1)[1]: q.datatype for q in quads if q.object_kind == "literal"}
    assert kinds["has_n"] == rdf.XSD_NS + "integer" and kinds["KNOWS_w"].startswith(rdf.XSD_NS)
    assert kinds["has_name"] == rdf.XSD_NS + "string"


def test_endpoints_have_their_own_type(small):
    nodes, edges, schema = small
    quads = rule_quads(None, raw(edges), schema, executable_rules(schema), label_nodes=nodes).collect()
    ends = {(q.subject.rsplit("/", 1)[1], q.predicate.rsplit("/", 1)[1]): q.object for q in quads
            if q.predicate.endswith(("/source", "/target"))}
    assert ends["e%202", "source"] == rdf.DEFAULT_BASE + "Node/3" and ends["e%202", "target"] == rdf.DEFAULT_BASE + "Bare/5"
    assert ends["e1", "source"] == rdf.DEFAULT_BASE + "A%3AB/1" and ends["e3", "target"] == rdf.DEFAULT_BASE + "Node/99"


def test_other_policies_and_errors(spark, small):
    nodes, _, schema = small
    own = (policies.Policy("flat", "id-{id}", "custom"),)
    quads = rule_quads(nodes, None, schema, executable_rules(schema, policies=own, generator="flat")).collect()
    assert {q.subject for q in quads} == {f"{rdf.DEFAULT_BASE}id-{i}" for i, *_ in NODES}
    for pattern in ("{id", "id}", "{}", "{{id}}"):
        with pytest.raises(ValueError):
            policies.holes(pattern)
    with pytest.raises(ValueError):
        executable_rules(schema, policies=(policies.Policy("x", "{nothing}", None),), generator="x")
    with pytest.raises(ValueError):
        policies.mint(policies.Policy("x", "{id}"), {}, {})


def test_policies_mint_alike_in_both_ways(spark):
    ns = {"custom": "https://c.example/"}
    df = spark.createDataFrame([("T", "1", "https://x.example/a"), ("U", "2", "not an iri"), ("", None, None)],
                               "type string, id string, text string")
    holes = {"type": F.col("type"), "id": F.col("id"), "label": F.col("id"), "text": F.col("text")}
    table = policies.policy_table(spark, policies.POLICIES, ns)
    filled = policies.finish(policies.fill(F.col("template"), holes, 2), F.col("kind"), ns["custom"])
    by_table = df.crossJoin(table).select("type", "name", filled.alias("iri")).collect()
    minted = df.select("type", *[policies.mint(p, holes, ns).alias(p.name) for p in policies.POLICIES]).collect()
    assert {(r.type, r.name): r.iri for r in by_table} == {(r.type, p.name): r[p.name] for r in minted for p in policies.POLICIES}
    r = minted[0]
    assert r.URIwithType == "https://c.example/T/1" and r.namedgraph == "https://c.example/T/1/graph" and r.Label == "1"
    assert r.URIwithTypeHashed == "https://c.example/" + hashlib.sha256(b"https://c.example/T/1").hexdigest()
    assert r.URIorUUID == "https://x.example/a" and minted[1].URIorUUID.startswith("urn:uuid:")
    assert policies.mint(policies.Policy("x", "a"), {}, {}) is not None


def test_empty_graph(spark, make_graph):
    nodes, edges = make_graph([], [])
    schema = discover_schema(nodes, edges)
    assert rule_quads(nodes, raw(edges), schema, executable_rules(schema)).count() == 0


def test_dense_number_equals_row_number(spark):
    n = 1_000_000
    ids = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 5)).alias("g"),
                                (F.col("id") * 7919 % n).alias("k"), F.lit("x").alias("_part"))
    got = dense_number(ids, ["k"], "g", "p", "size")
    w = Window.partitionBy("g").orderBy("k")
    want = ids.select("g", "k", (F.row_number().over(w) - 1).alias("p"), F.count("*").over(Window.partitionBy("g")).alias("size"))
    assert got.select("g", "k", "p", "size").exceptAll(want).count() == 0 and got.count() == n
    whole = dense_number(ids, [F.col("k").desc()]).agg(F.count_distinct("pos"), F.max("pos"), F.max(F.abs(F.col("pos") + F.col("k") + 1 - n)))
    assert tuple(whole.first()) == (n, n - 1, 0)


def test_dense_number_of_equal_rows_and_nulls(spark):
    rows = [(None, None)] * 5 + [("a", 1)] * 5 + [("a", None)]
    got = dense_number(spark.createDataFrame(rows, "g string, k int").repartition(4), ["k"], "g", "p", "size").collect()
    assert sorted(r.p for r in got if r.g is None) == [0, 1, 2, 3, 4] and {r["size"] for r in got if r.g == "a"} == {6}
    assert [r.p for r in got if r.g == "a" and r.k is None] == [0]
    empty = spark.createDataFrame([], "g string, k int")
    assert dense_number(empty, ["k"], "g").count() == 0
