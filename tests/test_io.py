"""CSV, XML and quads on values and names that ordinary graphs hold."""

import os

import pytest
from pyspark.sql import functions as F

from graphsift.plans import rdf
from graphsift.plans.discovery import discover_schema
from graphsift.sources import csvio, xmlio
from graphsift.sources.graph import EdgeSpec, NodeSpec, read_edges, read_nodes

ODD = {"id": "7", "first name": 'a "q" | b\nnext, line\\', "blank": "", "spaces": "  x ", "Ä": "ö", "a:b": "c",
       "source": "s", "type_name": "t"}


def _nodes(make_graph):
    return make_graph([(1, ["Ä"], ODD), (2, ["Ö", "Per son"], {"id": "8"}), (3, None, {"p": "v"}), (4, [], {})],
                      [("e|1", 1, 2, "KNOWS", ["Ä"], ["Ö", "Per son"], {"source": "x", "target": "y", "id": "z"}),
                       ("e2", 2, 3, "KNOWS", ["Ö", "Per son"], [], {})])


def test_csv_round_trip_of_odd_values(spark, make_graph, tmp_path):
    nodes, edges = _nodes(make_graph)
    n, e = csvio.write_graph_csv(nodes, edges, str(tmp_path / "g"))
    back, back_edges = csvio.graph_from_csv(spark, {None: n}, {None: e})
    got = {r.node_id: (r.labels, r.props) for r in back.collect()}
    assert got == {1: (["Ä"], ODD), 2: (["Ö", "Per son"], {"id": "8"}), 3: ([], {"p": "v"}), 4: ([], {})}
    assert {r.edge_id: r.props for r in back_edges.collect()} == {
        "e|1": {"source": "x", "target": "y", "id": "z"}, "e2": {}}


def _file(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path.parent)


def test_bulk_import_headers(spark, tmp_path):
    people = _file(tmp_path / "person" / "a.csv", "id:ID(Person)|name:string|tags:string[]|skip:IGNORE\n1|Ann|x;y|n\n2|Bob||n\n")
    cities = _file(tmp_path / "city" / "a.csv", ":ID(City)|name|:LABEL\n1|Rome|Town;Old\n")
    _file(tmp_path / "lives" / "a.csv", ":START_ID(Person)|:END_ID(City)|weight:int\n1|1|5\n")
    lives = _file(tmp_path / "lives" / "b.csv", "roi|:END_ID(City)|:START_ID(Person)\nleft|1|2\n")
    nodes, edges = csvio.graph_from_csv(spark, {"Person": people, "City": cities}, {"LIVES_IN": lives})
    got = {(tuple(r.labels), r.props.get("name")): r.node_id for r in nodes.collect()}
    assert set(got) == {(("Person",), "Ann"), (("Person",), "Bob"), (("Town", "Old", "City"), "Rome")}
    assert len(set(got.values())) == 3                       # id 1 of two spaces is two nodes
    rows = {(r.src_id, r.dst_id): (r.props, r.src_labels, r.dst_labels) for r in edges.collect()}
    rome = got[("Town", "Old", "City"), "Rome"]
    assert rows == {(got[("Person",), "Ann"], rome): ({"weight": "5"}, ["Person"], ["Town", "Old", "City"]),
                    (got[("Person",), "Bob"], rome): ({"roi": "left"}, ["Person"], ["Town", "Old", "City"])}
    with pytest.raises(ValueError):
        csvio.read_csv_nodes(spark, {"X": lives})


def test_xml_round_trip_and_chunks(spark, make_graph, tmp_path):
    nodes, edges = _nodes(make_graph)
    path = str(tmp_path / "xml")
    xmlio.export_node_xml(nodes, discover_schema(nodes, edges), path)
    back = {r.id: {p["_name"]: p["_VALUE"] for p in r.property or []}
            for r in xmlio.read_xml_elements(spark, path, "node").collect()}
    assert back == {"1": {k: v for k, v in ODD.items() if v.strip()}, "2": {"id": "8"}, "3": {"p": "v"}, "4": {}}
    many = spark.range(100).selectExpr("concat('e', id) AS edge_id", "id AS src_id", "id AS dst_id", "'R' AS rel_type",
                                       "array('A') AS src_labels", "array('B') AS dst_labels",
                                       "map('source', 'x') AS props").coalesce(1)
    xmlio.export_edge_xml(many, path + "e", items_per_file=30)
    files = [f for _, _, names in os.walk(path + "e") for f in names if f.endswith(".xml")]
    read = xmlio.read_xml_elements(spark, path + "e", "edge")
    assert len(files) == 4 and read.count() == 100
    assert read.where("source._type = 'A' AND property[0]._name = 'source'").count() == 100


def test_quads_of_odd_names(make_graph):
    nodes, edges = _nodes(make_graph)
    quads = rdf.node_quads(nodes, discover_schema(nodes, edges))
    rows = quads.collect()
    assert {r.subject.rsplit("/", 1)[1] for r in rows} == {"1", "2", "3", "4"}        # null labels drop no node
    assert "https://example.org/has_first%20name" in {r.predicate for r in rows}
    classes = {r.object for r in rows if r.predicate.endswith("#type")}
    assert len({c for c in classes if "%C3" in c or "Ä" in c or "Ö" in c}) == 2
    assert not any(c in r.subject + r.predicate for r in rows for c in ' <>"|\n')


@pytest.mark.parametrize("fmt", ["nquads", "trig"])
@pytest.mark.parametrize("shape", ["link", "reified"])
def test_written_quads_read_back(spark, make_graph, tmp_path, fmt, shape):
    nodes, edges = _nodes(make_graph)
    quads = rdf.node_quads(nodes, discover_schema(nodes, edges), shape).unionByName(
        rdf.edge_quads(edges, shape))
    path = str(tmp_path / "q")
    rdf.write_quads(quads, path, fmt, max_records=5)
    lines = [r.value for r in spark.read.text(path).collect()]
    expected = rdf.nquads_lines(quads) if fmt == "nquads" else rdf.trig_lines(quads)
    assert sorted(lines) == sorted(r.line for r in expected.collect())
    end = " ." if fmt == "nquads" else " . }"
    assert all(x.endswith(end) for x in lines) and quads.count() == len(lines)


def test_lists_nulls_and_mixed_specs(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [1, 2]), (2, None, None)], "id int, tags array<string>, nums array<int>")
    for tags in ("tags", F.col("tags")):
        nodes = read_nodes(spark, [NodeSpec(df, "id", F.lit(None).cast("array<string>"), {"tags": tags, "nums": "nums"})])
        assert {r.node_id: (r.labels, r.props) for r in nodes.collect()} == {
            1: ([], {"tags": "a,b", "nums": "1,2"}), 2: ([], {})}
    edges = read_edges(spark, [EdgeSpec(df, "R", F.col("id"), "id + 1", {"t": "concat('x', id)"}, edge_id="id * 10")], None)
    assert {(r.edge_id, r.src_id, r.dst_id, r.props["t"]) for r in edges.collect()} == {("10", 1, 2, "x1"), ("20", 2, 3, "x2")}


def test_separators_in_names_keep_patterns_apart(make_graph):
    from graphsift.operators.patterns import exact_node_clusters, node_patterns
    nodes, _ = make_graph([(1, ["A"], {"a,b": "1"}), (2, ["A"], {"a": "1", "b": "2"}), (3, ["x:y"], {}),
                           (4, ["x", "y"], {}), (5, ["x\\"], {})])
    ids = [r.cluster_id for r in exact_node_clusters(node_patterns(nodes)).collect()]
    assert len(set(ids)) == 5
