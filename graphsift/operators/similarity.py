"""Exact set-similarity join (Jaccard >= t) without a Cartesian product.

All tokens are ordered globally by (frequency, token), rarest first. Sets of m
and n tokens with Jaccard >= t share at least k = ceil(t / (1 + t) * (m + n))
tokens, so they share one among the first m - k + 1 of the one and n - k + 1 of
the other. Lists are therefore keyed by token *and both sizes*: a set enters
the lists of a size it can pair with using just the tokens that this size needs.
That is shorter than the prefix for any size (with t = 0.3 that one is almost the
whole set), and a token that nearly all sets carry, last in the order, is in
hardly any list. A pair met at places i and j must also have k tokens left
from there on, counting this one. Candidates are then verified exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EPS = 1e-9


def _lists(sets: DataFrame, freq: DataFrame, t: float, sizes: list[int], own: str, other: str) -> DataFrame:
    """(id, token, place, <own>, <other>): the lists that every set is in, by
    its own size and the sizes of possible partners."""
    exploded = sets.select("id", "size", F.explode("set").alias("token"))
    ranked = (exploded.join(freq, "token")
              .groupBy("id", "size")
              .agg(F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("ordered")))
    placed = ranked.select("id", "size", F.posexplode("ordered").alias("place", "e"))
    size, place = F.col("size"), F.col("place")
    partners = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: (
        (n >= size * t - _EPS) & (size >= n * t - _EPS) & (place <= size - _needed(size, n, t))))
    return placed.select("id", F.col("e.token").alias("token"), "place", size.alias(own), F.explode(partners).alias(other))


def _needed(m, n, t: float):
    """Tokens that sets of m and n tokens with Jaccard >= t share at least."""
    return F.ceil((m + n) * F.lit(t / (1 + t)) - F.lit(_EPS))


def candidates(a: DataFrame, b: DataFrame | None, threshold: float) -> DataFrame:
    """(a, b): pairs of ids that meet in some list; with ``b=None`` of one
    table, once each (a < b). Rows have (id, set, size)."""
    right = a if b is None else b
    tokens = a.select(F.explode("set").alias("token"))
    if b is not None:
        tokens = tokens.unionAll(b.select(F.explode("set").alias("token")))
    freq = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    # Sizes: as many as the largest set has tokens at most.
    sizes = a.select("size", F.lit(True).alias("left"))
    if b is not None:
        sizes = sizes.unionAll(b.select("size", F.lit(False)))
    sizes = sizes.distinct().collect()
    sizes_a = [r["size"] for r in sizes if r["left"]]
    sizes_b = sizes_a if b is None else [r["size"] for r in sizes if not r["left"]]
    la = _lists(a, freq, threshold, sizes_b, "m", "n").withColumnsRenamed({"id": "a", "place": "i"})
    lb = _lists(right, freq, threshold, sizes_a, "n", "m").withColumnsRenamed({"id": "b", "place": "j"})
    left_over = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j"))
    met = la.join(lb, ["token", "m", "n"]).where(left_over >= _needed(F.col("m"), F.col("n"), threshold))
    if b is None:
        met = met.where(F.col("a") < F.col("b"))
    return met.select("a", "b").distinct()


def _prep(df: DataFrame, id_col: str, set_col: str) -> DataFrame:
    s = F.array_distinct(F.filter(F.col(set_col), lambda x: x.isNotNull()))
    return (df.select(F.col(id_col).alias("id"), s.alias("set"))
            .withColumn("size", F.size("set"))
            .where(F.col("size") > 0))


def jaccard_join(left: DataFrame, right: DataFrame | None, left_id: str, left_set: str,
                 right_id: str | None = None, right_set: str | None = None,
                 threshold: float = 0.9) -> DataFrame:
    """All (left_id, right_id, jaccard) with Jaccard >= threshold.

    ``right=None`` is a self-join returning each unordered pair once (a < b).
    Output columns: ``a``, ``b``, ``inter``, ``jaccard``. Rows with equal sets
    are paired with each other; to keep those apart, join distinct sets
    (:func:`distinct_sets`).
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be in (0, 1]")
    t = float(threshold)
    a = _prep(left, left_id, left_set)
    b = a if right is None else _prep(right, right_id or left_id, right_set or left_set)

    cand = candidates(a, None if right is None else b, t)
    sa = a.select(F.col("id").alias("a"), F.col("set").alias("sa"), F.col("size").alias("na"))
    sb = b.select(F.col("id").alias("b"), F.col("set").alias("sb"), F.col("size").alias("nb"))
    pairs = (cand.join(sa, "a").join(sb, "b")
             .withColumn("inter", F.size(F.array_intersect("sa", "sb")))
             .withColumn("jaccard", F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter")))
             .where(F.col("jaccard") >= F.lit(t) - F.lit(_EPS)))
    return pairs.select("a", "b", "inter", "jaccard")


def distinct_sets(df: DataFrame, id_col: str, set_col: str) -> tuple[DataFrame, DataFrame]:
    """(representatives, members): one row per distinct set, named by its
    smallest id, and (id, rep) of every row. Rows with empty sets are left out.

    Any number of rows with the same set costs one row per task here, so a
    later self-join of the representatives never pairs equal sets.
    """
    rows = _prep(df, id_col, set_col).select("id", F.array_sort("set").alias("set"))
    reps = rows.groupBy("set").agg(F.min("id").alias("rep"))
    members = rows.join(reps, "set").select("id", "rep")
    return reps, members
