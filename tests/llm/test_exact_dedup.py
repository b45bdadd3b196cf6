"""Streaming exact dedup against brute force, restarts and digest clashes."""

from hashlib import sha256

from pyspark.sql import functions as F

from graphsift.llm import exact_dedup
from graphsift.session import shared_path

ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "a "), (7, "A"), (3, "b"), (None, "c"), (None, "c"),
        (8, "c"), (None, "d"), (9, "x" * 200_000), (10, "x" * 200_000), *[(100 + i, "hot") for i in range(300)]]
SCHEMA = "doc_id bigint, text string, kept int, digest string, `_metadata` string, `file.x` string, row_id string"


def frame(spark, rows=ROWS, parts=3):
    return spark.createDataFrame([(i, t, 7, "d", "s", "f", "r") for i, t in rows], SCHEMA).repartition(parts)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), sha256((t or "").encode()).hexdigest()) for i, t in rows),
                  key=str)


def test_against_brute_force(spark):
    out = exact_dedup.exact_dedup(frame(spark)).select(
        "row_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("d"), "kept", "row.text")
    rows = out.collect()
    assert sorted(((r.row_id, r.keep_id, r.group_size, r.d) for r in rows), key=str) == brute(ROWS)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({t or "" for _, t in ROWS})         # exactly one of each, also of repeated rows
    assert all(r.row_id == r.keep_id for r in kept)


def test_state_goes_on_when_files_arrive(spark):
    path, checkpoint = shared_path(spark, "test"), shared_path(spark, "test")
    frame(spark, [(1, "a"), (2, "b")], 1).write.parquet(path)
    schema = spark.read.parquet(path).schema
    first = exact_dedup.update_state(spark, path, schema, checkpoint)
    assert sorted((r.group_size, r.keeper.row_id) for r in first.collect()) == [(1, 1), (1, 2)]
    frame(spark, [(9, "a"), (5, "c"), (0, "b")], 1).write.mode("append").parquet(path)
    rows = exact_dedup.dedup_table(spark, path, schema, checkpoint=checkpoint).collect()
    assert sorted((r.row_id, r.keep_id, r.group_size, r.kept) for r in rows) == [
        (0, 2, 2, False), (1, 9, 2, False), (2, 2, 2, True), (5, 5, 1, True), (9, 9, 2, True)]


def test_texts_below_one_digest_are_told_apart(spark):
    rows = spark.createDataFrame(
        [((1,), 1, "p", b"same", "f", 0), ((2,), 2, "p", b"same", "f", 1), ((3,), 3, "q", b"same", "f", 2),
         ((4,), 4, "r", b"other", "f", 3)],
        "row struct<x:int>, row_id bigint, content string, digest binary, file string, pos bigint")
    hits = spark.createDataFrame([(b"same", 3, (3, "f", 2))],
                                 "hit binary, size bigint, keeper struct<row_id:bigint,file:string,pos:bigint>")
    members = rows.join(hits, F.col("digest") == F.col("hit"), "left")
    contested = spark.createDataFrame([(b"same",)], "contested binary")
    out = exact_dedup._by_whole_text(rows, members, contested)
    assert sorted((r.row_id, r.size, r.keeper.row_id if r.keeper else None) for r in out.collect()) == [
        (1, 2, 2), (2, 2, 2), (3, 1, 3), (4, None, None)]


def test_plan_has_no_python(spark):
    out = exact_dedup.exact_dedup(frame(spark))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(frame(spark, [], 1)).count() == 0
