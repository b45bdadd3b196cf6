"""LSH clustering invariants (results depend on seed and table count)."""

from pyspark.sql import functions as F

from graphsift.operators import lsh, patterns
from graphsift.plans.catalog import graph

SF = "/root/testdata/sf0.001"


def test_lsh_invariants(spark):
    nodes, edges = graph(spark, SF)
    pats = patterns.node_patterns(nodes)
    for code in ("word2vec", "hash"):
        c = lsh.lsh_cluster_nodes(pats, code=code).cache()
        assert c.count() == pats.count()  # every pattern in exactly one cluster
        assert c.select("labels_key", "prop_keys").distinct().count() == c.count()
        assert c.agg(F.sum("n")).first()[0] == nodes.count()
        assert c.select("cluster_id").distinct().count() <= c.count()
    ec = lsh.lsh_cluster_edges(patterns.edge_patterns(edges), code="hash")
    assert ec.agg(F.sum("n")).first()[0] == edges.count()


def test_param_rule():
    import pytest
    b, t = lsh.estimate_lsh_params(2.0, 100, False, 2)       # <=3 label sets: x0.5, x1.5
    assert b == pytest.approx(0.3) and t == 7
    b, t = lsh.estimate_lsh_params(2.0, 400000, False, 20)   # >10: x1.5, x0.7; 10 tables -> 7
    assert b == pytest.approx(0.9) and t == 7
    assert lsh.estimate_lsh_params(0.0, 10, True) == (0.2, 3)  # zero guard
    b, t = lsh.estimate_lsh_params(1.0, 10**7, True)
    assert b == pytest.approx(0.2) and t == 8


def test_distance_stats(spark):
    nodes, _ = graph(spark, SF)
    from graphsift.operators.encode import encode_node_patterns
    st = lsh.pattern_distance_stats(encode_node_patterns(patterns.node_patterns(nodes), code="hash")).first()
    assert st["pairs"] > 0 and st["min_distance"] > 0 and st["max_distance"] >= st["avg_distance"]


def test_rare_patterns_count(spark):
    """A pattern of one element at distance 50 among a billion others is seen."""
    rows = [("A", [], 10**9, [0.0, 0.0]), ("B", [], 10**9, [1.0, 0.0]), ("C", [], 1, [0.0, 50.0])]
    enc = spark.createDataFrame(rows, "labels_key string, prop_keys array<string>, n bigint, features_arr array<double>")
    st = lsh.pattern_distance_stats(enc).first()
    assert st["max_distance"] >= 50.0 and abs(st["avg_distance"] - 1.0) < 1e-6


ENCODED = "labels_key string, prop_keys array<string>, n bigint, features_arr array<double>"


def exact_average(rows):
    import numpy as np
    n = np.array([r[2] for r in rows], float)
    x = np.array([r[3] for r in rows])
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    w = np.outer(n, n) * (d > 0)
    return (w * d).sum() / w.sum()


def test_all_pairs_of_few_patterns(spark):
    rows = [(f"L{i}", [], i * i + 1, [float(i % 9), float(i % 4)]) for i in range(150)]
    st = lsh.pattern_distance_stats(spark.createDataFrame(rows, ENCODED)).first()
    equal = sum(a[3] == b[3] for a in rows for b in rows)
    assert st["pairs"] == 150 * 150 - equal and abs(st["avg_distance"] - exact_average(rows)) < 1e-9


def test_two_patterns_with_a_third_each(spark):
    """Of 5,000 patterns two hold a third of the elements each: the average is that of all pairs to 1 %."""
    import numpy as np
    rng = np.random.default_rng(1)
    rows = [(f"L{i}", [], int(rng.integers(1, 50)), rng.random(4).tolist()) for i in range(4998)]
    total = sum(r[2] for r in rows)
    rows += [("H1", [], total, [5.0, 0.0, 0.0, 0.0]), ("H2", [], total, [0.0, 0.0, 9.0, 0.0])]
    enc = spark.createDataFrame(rows, ENCODED).repartition(7)
    st = lsh.pattern_distance_stats(enc).first()
    assert abs(st["avg_distance"] / exact_average(rows) - 1) < 0.01
    sample = lsh.partner_sample(enc).collect()
    assert {"H1#", "H2#"} <= {r.p2 for r in sample} and len(sample) < 2 * lsh.PARTNERS
    assert st == lsh.pattern_distance_stats(enc.coalesce(1)).first() or abs(
        st["avg_distance"] - lsh.pattern_distance_stats(enc.coalesce(1)).first()["avg_distance"]) < 1e-9


def test_estimate_is_unbiased(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    rows = [(f"L{i}", [], int(rng.pareto(1.2) * 10) + 1, rng.random(3).tolist()) for i in range(1000)]
    enc = spark.createDataFrame(rows, ENCODED).cache()
    got = [lsh.pattern_distance_stats(enc, partners=100, seed=k).first()["avg_distance"] for k in range(6)]
    assert abs(np.mean(got) / exact_average(rows) - 1) < 0.03


def test_empty_input(spark):
    nodes = spark.createDataFrame([], "labels_key string, prop_keys array<string>, n bigint")
    edges = spark.createDataFrame([], "rel_type string, src_key string, dst_key string, prop_keys array<string>, n bigint")
    for out, key in ((lsh.lsh_cluster_nodes(nodes), "labels_key"), (lsh.lsh_cluster_edges(edges), "rel_type")):
        assert out.count() == 0 and {key, "prop_keys", "n", "cluster_id"} <= set(out.columns)
    assert lsh.pattern_distance_stats(spark.createDataFrame([], ENCODED)).first()["pairs"] == 0


def test_flags_of_more_than_a_thousand_properties(make_graph, monkeypatch, spark):
    from graphsift.plans import catalog
    names = {f"p{i:04d}": "1" for i in range(1100)}
    built = make_graph([(1, ["A"], names), (2, ["B"], {"p0000": "1"})],
                       [("e1", 1, 2, "R", ["A"], ["B"], names), ("e2", 2, 1, "S", ["B"], ["A"], {"p0000": "1"})])
    monkeypatch.setattr(catalog, "graph", lambda *_: built)
    for query, codes in ((catalog.q_encoded_patterns, 5), (catalog.q_encoded_edge_patterns, 18)):
        flags = sorted(r.flags.split(",") for r in query(spark, "").collect())
        assert [len(f) for f in flags] == [1100, 1100]
        assert sorted(sum(map(float, f)) for f in flags) == [1.0, 1100.0]
