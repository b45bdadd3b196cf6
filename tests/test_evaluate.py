"""Evaluation metrics (EVA1-8) on a small graph with known labels."""

import pytest
from pyspark.sql import functions as F

from graphsift.operators.evaluate import assignments_nodes, clustering_metrics, majority_labels
from graphsift.plans.discovery import discover_schema


def test_metrics_with_truth_frame(spark, make_graph):
    n, e = make_graph([(1, ["A"], {"x": "1"}), (2, ["A"], {"x": "2"}), (3, ["A"], {"x": "3"}),
                       (4, ["B"], {"y": "1"}), (5, [], {"q": "1"})])
    s = discover_schema(n, e, materialize=False)
    truth = spark.createDataFrame([(1, ["A"]), (2, ["A"]), (3, ["C"]), (4, ["B"])],
                                  "node_id bigint, true_labels array<string>")
    a = assignments_nodes(n, s.node_pattern_types, s.node_types, truth)
    rows = {r["node_id"]: r for r in a.collect()}
    assert rows[5]["actual_labels"] == []            # no truth -> empty list (left join)
    assert rows[1]["correct_strict"] == 1 and rows[3]["correct_non_strict"] == 0
    maj = {r["type_id"]: r["majority_label"] for r in majority_labels(a).collect()}
    assert maj["A"] == "A" and maj["B"] == "B"
    m = clustering_metrics(a, F.array_join(F.sort_array("actual_labels"), ",")).first()
    # type A: nodes 1,2 correct, 3 wrong; B: 4 correct; node 5 has no labels -> no majority, dropped
    assert (m["tp"], m["fp"], m["fn"]) == (3, 1, 1)
    assert m["precision"] == pytest.approx(0.75) and m["recall"] == pytest.approx(0.75)
    assert m["f1"] == pytest.approx(0.75)


def test_missing_truth_columns(spark, make_graph):
    n, e = make_graph([(1, ["A"], {"x": "1"})])
    s = discover_schema(n, e, materialize=False)
    bad = spark.createDataFrame([(1,)], "node_id bigint")
    with pytest.raises(ValueError):
        assignments_nodes(n, s.node_pattern_types, s.node_types, bad)
