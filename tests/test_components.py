"""Connected components: long chains, stars, repeated edges, no edges."""

from graphsift.operators.components import component_roots, connected_components


def _edges(spark, rows):
    return spark.createDataFrame(rows, "a bigint, b bigint")


def test_chain_longer_than_any_old_round_cap(spark):
    n = 300
    roots = component_roots(_edges(spark, [(i, i + 1) for i in range(n)]))
    assert {r.id: r.root for r in roots.collect()} == {i: 0 for i in range(n + 1)}


def test_star_cycle_loops_and_lonely_vertices(spark):
    edges = _edges(spark, [(9, k) for k in range(10, 60)] + [(9, 3), (3, 9), (70, 71), (71, 72), (72, 70),
                                                            (80, 80), (None, 5), (5, None)])
    vertices = spark.createDataFrame([(i,) for i in (3, 9, 10, 59, 70, 72, 80, 5)], "id bigint")
    got = {r.id: r.component for r in connected_components(vertices, edges).collect()}
    assert got == {3: 3, 9: 3, 10: 3, 59: 3, 70: 70, 72: 70, 80: 80, 5: 5}


def test_no_edges(spark):
    assert component_roots(_edges(spark, [])).count() == 0
