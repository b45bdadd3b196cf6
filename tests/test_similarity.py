"""Prefix-filtered Jaccard join equals brute force; components are exact."""

import itertools
import random

import pytest

from graphsift.operators.similarity import jaccard_join
from graphsift.operators.components import connected_components


def _sets(seed, n, vocab=12, max_len=8):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = rnd.randint(1, max_len)
        out.append((f"s{i:03d}", sorted(rnd.sample([f"t{j}" for j in range(vocab)], k))))
    return out


def _jac(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("t", [0.3, 0.5, 0.75, 0.9, 1.0])
def test_join_matches_brute_force(spark, t):
    left, right = _sets(1, 40), _sets(2, 30)
    L = spark.createDataFrame(left, "id string, s array<string>")
    R = spark.createDataFrame(right, "id string, s array<string>")
    got = {(r["a"], r["b"]) for r in jaccard_join(L, R, "id", "s", "id", "s", t).collect()}
    want = {(a, b) for (a, sa), (b, sb) in itertools.product(left, right) if _jac(sa, sb) >= t - 1e-9}
    assert got == want


@pytest.mark.parametrize("t", [0.4, 0.8])
def test_self_join_matches_brute_force(spark, t):
    sets = _sets(3, 50, vocab=8)
    df = spark.createDataFrame(sets, "id string, s array<string>")
    got = {(r["a"], r["b"]) for r in jaccard_join(df, None, "id", "s", threshold=t).collect()}
    want = {(a, b) for (a, sa), (b, sb) in itertools.combinations(sets, 2) if _jac(sa, sb) >= t - 1e-9}
    assert got == want


def test_threshold_must_be_positive(spark):
    df = spark.createDataFrame([("a", ["x"])], "id string, s array<string>")
    with pytest.raises(ValueError):
        jaccard_join(df, None, "id", "s", threshold=0.0)


def test_connected_components_chain(spark):
    v = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("f", "g")], "a string, b string")
    got = {r["id"]: r["component"] for r in connected_components(v, e).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f", "g": "f"}


def test_a_shared_token_makes_no_candidates(spark):
    """100,000 sets of three tokens of which one is in all of them, at a low threshold."""
    from pyspark.sql import functions as F
    from graphsift.operators import similarity
    n = 100_000
    ids = spark.range(n)
    sets = ids.select("id", F.array(F.lit("all"), F.concat(F.lit("u"), F.col("id")),
                                    F.concat(F.lit("v"), F.floor(F.col("id") / 2) * F.when(F.col("id") < 20, 1).otherwise(0)
                                             + F.when(F.col("id") < 20, 0).otherwise(F.col("id")))).alias("s"))
    prepared = similarity._prep(sets, "id", "s")
    assert similarity.candidates(prepared, None, 0.3).count() == 10
    got = similarity.jaccard_join(sets, None, "id", "s", threshold=0.3).collect()
    assert sorted((r.a, r.b, r.inter) for r in got) == [(2 * k, 2 * k + 1, 2) for k in range(10)]


def test_low_thresholds_against_brute_force(spark):
    import random
    from graphsift.operators import similarity
    rng = random.Random(3)
    rows = [(i, rng.sample([f"t{k}" for k in range(14)], rng.randint(0, 9))) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, s array<string>")
    for t in (0.1, 0.3, 0.5, 0.75, 1.0):
        want = sorted((i, j) for i, x in rows for j, y in rows if i < j and x and y
                      and len(set(x) & set(y)) / len(set(x) | set(y)) >= t - 1e-9)
        assert sorted((r.a, r.b) for r in similarity.jaccard_join(df, None, "id", "s", threshold=t).collect()) == want
    other = spark.createDataFrame(rows[:60], "id int, s array<string>")
    want = sorted((i, j) for i, x in rows for j, y in rows[:60] if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.4)
    assert sorted((r.a, r.b) for r in similarity.jaccard_join(df, other, "id", "s", "id", "s", 0.4).collect()) == want
