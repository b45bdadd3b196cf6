"""Merkle manifest against brute force, odd rows and tampering."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from graphsift.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id bigint, source string, lang string, n_chars int, text string, h string, pos int, g string, `left` string"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i:i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def path(tree, pos, fanout):
    steps = []
    for level in tree[:-1]:
        start = pos // fanout * fanout
        steps.append(("".join(level[start:pos]), "".join(level[pos + 1:start + fanout])))
        pos //= fanout
    return steps


def brute(rows, fanout):
    """Per row: (id, lang, leaf, subroot, root, digest of its proof), sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g])], fanout) for g in names}
    top = levels([trees[g][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for pos, (known, i, h) in enumerate(sorted(groups[g])):
            steps = path(trees[g], pos, fanout) + path(top, k, fanout)
            out.append((i if known else None, g, h, trees[g][-1][0], top[-1][0], digest("".join(a + b for a, b in steps))))
    return sorted(out, key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(parts)


def result(out):
    rows = out.select("doc_id", "lang", *[merkle.hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
                      merkle.proof_digest().alias("p"), merkle.fold(F.col("leaf")).alias("folded")).collect()
    assert all(r.folded == r.root for r in rows)
    return sorted((tuple(r)[:6] for r in rows), key=str)


ROWS = [*[(i, f"s{i % 3}", "hot", i, f"Text {i}") for i in range(600)],      # one group holds most rows
        *[(i, "s", lang, 1, "é" * (i % 5)) for i, lang in enumerate(["", "a", "A", "Ä", "z", "b1", "b2", "b3", "b4"])],
        (None, None, None, None, None), (7, None, None, 0, ""), (7, None, None, 0, ""), (None, "-", "a", None, "-"),
        (1, "s", "long", 9, "x" * 300_000)]


#: Groups of one row, of whole and of partial runs and levels.
EVEN = [(i, "s", f"n{n}", i, "t") for n in (1, 7, 8, 9, 64, 65) for i in range(n)]


@pytest.mark.parametrize("rows, fanout, parts", [(ROWS, 8, 1), (ROWS, 3, 7), (EVEN, 8, 2), (EVEN[:1], 8, 1)])
def test_against_brute_force(spark, rows, fanout, parts):
    assert result(merkle.manifest(frame(spark, rows, parts), FIELDS, fanout=fanout)) == brute(rows, fanout)


def test_empty_table(spark):
    assert merkle.manifest(frame(spark, []), FIELDS).count() == 0


def test_tampered_rows_do_not_verify(spark):
    docs = frame(spark, ROWS)
    claim = merkle.leaf_digest([*[F.col(c) for c in FIELDS[:-1]], merkle.lower_a_to_z(F.col("text"))])
    out = merkle.manifest(docs, FIELDS, claim=F.when(F.col("doc_id") % 2 == 0, claim))
    rows = out.select("lang", "doc_id", (merkle.fold(F.coalesce("claim", "leaf")) == merkle.hex_of(F.col("root"))).alias("ok"),
                      "claim").collect()
    for r in rows:
        assert r.ok == (not (r.lang == "hot" and r.doc_id % 2 == 0))
    assert any(r.ok and r.claim is not None for r in rows)       # a text without capitals stays what it was
