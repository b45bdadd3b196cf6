"""Connected components by alternating star contraction (DataFrame only).

The edge list is rewritten until every vertex hangs directly on the smallest
id of its component: a *large star* step links every larger neighbour of a
vertex to the smallest id in its neighbourhood, a *small star* step does the
same for its smaller neighbours and itself. Rounds needed grow with the
logarithm of the component size, not with its diameter. The loop ends only
when a round changes nothing; there is no round cap that could hand out
unfinished labels.

Each round is cut into a table of the shared folder, so lineage stays short
and a lost executor costs one round. The minima of a round are a table of their
own, too: both sides of the joins with them are then plain exchanges, whose
large partitions adaptive execution splits, so a vertex with any share of the
edges does not stay in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsift.session import cut_lineage, drop_table


def _minima(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour-or-self per vertex ``u`` of directed pairs (u, v), as a table."""
    return cut_lineage(pairs.groupBy("u").agg(F.min("v").alias("m"))
                       .select(F.col("u").alias("mu"), F.least("u", "m").alias("m")))


def _large_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    both = edges.select("u", "v").unionByName(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    used.append(_minima(both))
    return (both.where(F.col("v") > F.col("u"))
            .join(used[-1], F.col("u") == F.col("mu"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct())


def _small_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    """``edges``, a table, point from the larger to the smaller id (u > v)."""
    mins = _minima(edges)
    used.append(mins)
    moved = (edges.join(mins, F.col("u") == F.col("mu"))
             .where(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(mins.select(F.col("mu").alias("u"), F.col("m").alias("v"))).distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex named by the undirected edges (a, b).

    ``root`` is the smallest id of the component. Self loops and repeated
    edges are harmless; edges with a null end are ignored; no edges give no
    rows. Ids may be of any ordered type.
    """
    oriented = (edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    current, state = cut_lineage(oriented), None
    while True:
        new_state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new_state == state or new_state[0] == 0:
            break
        state, used = new_state, [current]
        used.append(cut_lineage(_large_star(current, used)))
        current = cut_lineage(_small_star(used[-1], used))
        for table in used:
            drop_table(table)
    members = current.select(F.col("u").alias("id"), F.col("v").alias("root"))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return members.unionByName(roots)


def connected_components(vertices: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, component) where component = smallest id in the vertex's component.

    ``vertices`` has ``id_col``; ``edges`` has columns ``a`` and ``b``
    (undirected). Vertices without edges are their own component.
    """
    ids = vertices.select(F.col(id_col).alias(id_col)).distinct()
    roots = component_roots(edges)
    return (ids.join(roots, ids[id_col] == roots["id"], "left")
            .select(ids[id_col], F.coalesce("root", ids[id_col]).alias("component")))
