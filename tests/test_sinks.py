"""Schema text, XSD fields, RDF quads on small unit graphs."""

from graphsift.plans import ddl, rdf
from graphsift.plans.discovery import discover_schema


def _graph(make_graph):
    return make_graph(
        [(1, ["Person"], {"name": "Ann", "age": "31", "idx": "7"}),
         (2, ["Person"], {"name": "Bob", "idx": "8", "id": "1"}),
         (3, ["City"], {"name": 'Q"u\\o\nte <&>'}),
         (4, [], {"zz": "1"})],
        [("k1", 1, 2, "KNOWS", ["Person"], ["Person"], {"since": "2020-01-01"}),
         ("k2", 1, 2, "LIKES", ["Person"], ["Person"], {}),
         ("l1", 1, 3, "LIVES_IN", ["Person"], ["City"], {}),
         ("l2", 2, 3, "LIVES_IN", ["Person"], ["City"], {})])


def test_strict_and_loose_ddl(make_graph):
    n, e = _graph(make_graph)
    s = discover_schema(n, e, materialize=False)
    strict = ddl.render(ddl.schema_ddl(s, "strict")).splitlines()
    assert "CREATE NODE TYPE PersonType : Person {idx INTEGER, name STRING, OPTIONAL age INTEGER, OPTIONAL id INTEGER};" in strict
    assert "CREATE NODE TYPE AbstractType_1 : ABSTRACT_1 {zz INTEGER};" in strict
    assert "CREATE EDGE TYPE knowsType : KNOWS {since DATE};" in strict
    assert "  (:PersonType)-[lives_inType]->(:CityType)," in strict
    # LIVES_IN: one city per person, two persons per city -> N:1
    assert "  FOR (x:PersonType) SINGLETON y WITHIN (x)-[y: lives_inType]->(:CityType)" in strict
    # KNOWS: one edge 1->2 -> 1:1
    assert "  FOR (x:PersonType) SINGLETON x,y WITHIN (x)-[y: knowsType]->(:PersonType)" in strict
    assert strict[0] == "-- NODE TYPES --" and strict[-1] == "}"
    loose = ddl.render(ddl.schema_ddl(s, "loose")).splitlines()
    assert loose[0] == "CREATE GRAPH TYPE NewGraphSchema LOOSE {"
    assert "  (PersonType: Person {idx INTEGER, name STRING, age INTEGER, id INTEGER})," in loose
    assert "  (:PersonType)-[KNOWSType: KNOWS {since DATE}]->(:PersonType)," in loose


def test_xsd_min_occurs_exact_name(make_graph):
    # Q11: `id` is optional even though `idx` is mandatory
    n, e = _graph(make_graph)
    f = {(r["type_name"], r["field"]): r for r in ddl.schema_fields(discover_schema(n, e, materialize=False)).collect()}
    assert f[("Person", "idx")]["min_occurs"] == 1
    assert f[("Person", "id")]["min_occurs"] == 0
    assert f[("UNKNOWN_1", "zz")]["min_occurs"] == 1
    assert f[("LIVES_IN", "source")]["xsd_type"] == "Person"


def test_quads_escape_and_parallel_edges(make_graph):
    n, e = _graph(make_graph)
    s = discover_schema(n, e, materialize=False)
    lines = [r["line"] for r in rdf.nquads_lines(rdf.node_quads(n, s, "reified")).collect()]
    assert '<https://example.org/City/3> <https://example.org/has_name> "Q\\"u\\\\o\\nte <&>" .' in lines
    assert "<https://example.org/Node/4> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <https://example.org/UNKNOWN_1> ." in lines
    # Q8/Q18: two edges between the same pair keep separate subjects
    eq = rdf.edge_quads(e, "reified").where("predicate = 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type'")
    subjects = {r["subject"] for r in eq.collect()}
    assert {"https://example.org/KNOWS/k1", "https://example.org/LIKES/k2"} <= subjects
    link = rdf.edge_quads(e, "link").collect()
    assert any(q["predicate"] == "https://example.org/custom/hasTarget" and q["object"] == "https://example.org/custom/City/3"
               for q in link)
    assert all(q["graph"] == "https://example.org/custom" for q in link)


def test_typed_literals(make_graph):
    n, e = _graph(make_graph)
    s = discover_schema(n, e, materialize=False)
    q = {r["predicate"]: r["datatype"] for r in rdf.node_quads(n, s, "reified", typed=True)
         .where("object_kind = 'literal'").collect()}
    assert q["https://example.org/has_age"] == "http://www.w3.org/2001/XMLSchema#integer"
    assert q["https://example.org/has_name"] == "http://www.w3.org/2001/XMLSchema#string"


def test_blank_values_make_no_triple(make_graph):
    n, e = make_graph([(1, ["A"], {"a": " ", "b": "x"})])
    s = discover_schema(n, e, materialize=False)
    preds = {r["predicate"] for r in rdf.node_quads(n, s).collect()}
    assert "https://example.org/has_b" in preds and "https://example.org/has_a" not in preds
