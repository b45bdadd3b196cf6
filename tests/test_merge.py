"""Merging rules and the quirk decisions on small unit frames."""

from pyspark.sql import functions as F

from graphsift.operators import merge, patterns
from graphsift.plans.discovery import discover_schema


def _types(schema):
    return {r["type_id"]: r for r in schema.node_types.collect()}


def test_disjoint_clusters_give_empty_intersection(make_graph):
    # Q4: {a},{b},{c} under one label -> nothing mandatory (no restart of the running ∩)
    n, e = make_graph([(1, ["L"], {"a": "1"}), (2, ["L"], {"b": "1"}), (3, ["L"], {"c": "1"})])
    for gran in ("instance", "cluster"):
        t = _types(discover_schema(n, e, granularity=gran, materialize=False))
        assert t["L"]["mandatory"] == [] and t["L"]["optional"] == ["a", "b", "c"]
        assert t["L"]["n"] == 3


def _unlabelled_two_matches(make_graph):
    props10 = {f"p{i}": "x" for i in range(10)}
    a = dict(props10)
    b = dict(props10, q="x")
    u = dict(props10)
    return make_graph([(1, ["A"], a), (2, ["B"], b), (3, [], u), (4, [], {"z": "1"})])


def test_unlabelled_best_match_and_multi(make_graph):
    n, e = _unlabelled_two_matches(make_graph)
    t = _types(discover_schema(n, e, materialize=False))
    # J(u, A) = 1.0, J(u, B) = 10/11 -> best match A only (Q2)
    assert t["A"]["n"] == 2 and t["B"]["n"] == 1
    # Q1: attaching keeps the type's own members and properties
    assert t["A"]["mandatory"] == sorted(f"p{i}" for i in range(10))
    abstract = [k for k in t if k.startswith("?")]
    assert len(abstract) == 1 and t[abstract[0]]["mandatory"] == ["z"]
    tm = _types(discover_schema(n, e, multi=True, materialize=False))
    assert tm["A"]["n"] == 2 and tm["B"]["n"] == 2


def test_tie_broken_by_label(make_graph):
    n, e = make_graph([(1, ["B"], {"x": "1"}), (2, ["A"], {"x": "1"}), (3, [], {"x": "2"})])
    t = _types(discover_schema(n, e, materialize=False))
    assert t["A"]["n"] == 2 and t["B"]["n"] == 1


def test_similarity_chain_components_vs_one_hop(spark):
    # Q7: a~b (J=0.9), b~c (J=0.9), a !~ c
    base = [f"l{i}" for i in range(9)]
    a = base + ["x"]
    b = base + ["x", "y"][:1] + []
    b = base + ["y"]
    rows = [("a", base + ["x"], ["p"], 1), ("b", base + ["x", "y"], ["p"], 1),
            ("c", base + ["x", "y", "z"], ["p"], 1)]
    cl = spark.createDataFrame(rows, "cluster_id string, labels array<string>, props array<string>, n bigint")
    pairs = {(r["a"], r["b"]) for r in merge.jaccard_pairs(cl, 0.9).collect()}
    assert pairs == {("a", "b"), ("b", "c")}
    comp = merge.merge_by_jaccard(cl, 0.9, "components").collect()
    assert len(comp) == 1 and (comp[0]["group_id"], comp[0]["n_clusters"]) == ("a", 3)
    hop = merge.merge_by_jaccard(cl, 0.9, "one_hop").collect()
    groups = sorted((r["group_id"], r["n_clusters"]) for r in hop)
    assert groups == [("a;b", 2), ("b;c", 2)]  # b sits in two groups, as in the reference


def test_one_label_with_many_patterns(spark):
    """5,000 clusters of one label set: links grow with the clusters, not with their pairs."""
    rows = [(f"c{i:04d}", "Same", [f"p{i % 700}", f"q{i // 700}"], 1) for i in range(5000)]
    assigned = spark.createDataFrame(rows, "cluster_id string, labels_key string, prop_keys array<string>, n bigint")
    clusters = merge.node_clusters(assigned)
    assert merge.jaccard_pairs(clusters, 0.9).count() == 4999
    types, _ = merge.merge_node_types(assigned)
    row = types.first()
    assert types.count() == 1 and row["n"] == 5000 and len(row["optional"]) == 708 and row["mandatory"] == []
    group = merge.merge_by_jaccard(clusters, 0.9).first()
    assert (group["n_clusters"], len(group["props"])) == (5000, 708)


def test_blank_endpoints_make_abstract_edge_type(make_graph):
    # Q20: blank and missing endpoint labels are treated alike
    n, e = make_graph(
        [(1, [], {"a": "1"}), (2, [""], {"a": "1"}), (3, ["X"], {"a": "1"})],
        [("e1", 1, 2, "R", [], [""], {}), ("e2", 3, 2, "R", ["X"], [""], {"w": "1"})])
    s = discover_schema(n, e, materialize=False)
    t = {r["type_id"]: r for r in s.edge_types.collect()}
    assert set(t) == {"R", "?R###"}
    assert t["R"]["src_labels"] == ["X"] and t["R"]["dst_labels"] == []
    assert t["R"]["mandatory"] == ["w"]


def test_edge_mandatory_is_instance_level(make_graph):
    # Q5: edge mandatory = intersection over edges
    n, e = make_graph([(1, ["A"], {}), (2, ["B"], {})],
                      [("e1", 1, 2, "R", ["A"], ["B"], {"x": "1", "y": "1"}),
                       ("e2", 1, 2, "R", ["A"], ["B"], {"x": "2"})])
    t = discover_schema(n, e, materialize=False).edge_types.collect()[0]
    assert t["mandatory"] == ["x"] and t["optional"] == ["y"] and t["n"] == 2


def test_schema_merge(spark):
    a = spark.createDataFrame([("T", ["T"], 2, ["a", "b"], ["c"])],
                              "type_id string, labels array<string>, n bigint, mandatory array<string>, optional array<string>")
    b = spark.createDataFrame([("T", ["T"], 3, ["a"], ["b", "d"]), ("U", ["U"], 1, ["u"], [])],
                              "type_id string, labels array<string>, n bigint, mandatory array<string>, optional array<string>")
    got = {r["type_id"]: r for r in merge.merge_schemas(a, b).collect()}
    assert got["T"]["n"] == 5 and got["T"]["mandatory"] == ["a"]
    assert got["T"]["optional"] == ["b", "c", "d"]
    assert got["U"]["mandatory"] == ["u"] and got["U"]["optional"] == []


def test_profile_by_label_splits_label_sets(make_graph):
    n, _ = make_graph([(1, ["A", "B"], {"x": "1", "y": "1"}), (2, ["A"], {"x": "1"})])
    p = {r["label"]: r for r in merge.profile_by_label(patterns.node_patterns(n)).collect()}
    assert p["A"]["common"] == ["x"] and p["A"]["optional"] == ["y"] and p["A"]["n"] == 2
    assert p["B"]["common"] == ["x", "y"] and p["B"]["n"] == 1


def test_safe_flatten(spark):
    df = spark.createDataFrame([([["a"], ["b"]], ["c"])], "p array<array<string>>, q array<string>")
    out = merge.safe_flatten(merge.safe_flatten(df, "p"), "q").collect()[0]
    assert out["p"] == ["a", "b"] and out["q"] == ["c"]


def test_empty_graph(make_graph):
    # CLU7: empty input keeps a typed, empty result
    n, e = make_graph([], [])
    s = discover_schema(n, e, materialize=False)
    assert s.node_types.count() == 0 and s.edge_types.count() == 0
    assert "mandatory" in s.node_types.columns
