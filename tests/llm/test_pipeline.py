"""The pipeline's stages against brute force on the smallest fixture."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphsift.llm import queries, toxicity
from graphsift.session import cut_lineage
from tests.llm.test_simhash import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_columns_and_decide_rightly(spark, steps):
    docs, calm, distinct, apart, clean, packed = steps
    assert all(d.columns == docs.columns for d in (calm, distinct, apart, clean))
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(rows(calm)) == {i for i, r in rows(docs).items() if not model.predict(r.text)[2]}
    best = {}
    for i, r in rows(calm).items():
        best[r.text or ""] = max(i, best.get(r.text or "", i))
    assert set(rows(distinct)) == set(best.values())
    groups = brute_components([(i, r.text) for i, r in rows(distinct).items()])
    assert set(rows(apart)) == {c for _, _, c in groups}
    before, after = rows(apart), rows(clean)
    assert set(before) == set(after)
    for i, r in after.items():
        assert r.n_chars == len(r.text) and (r.text == before[i].text or "[SECRET]" in r.text)
    assert {r.doc_id for r in packed.collect()} == set(after)


def test_run_is_the_stages(spark, steps):
    cols = ["doc_id", "start", "length", "ids_crc32"]
    got, want = corpus_pipeline.run(spark, SF), steps[-1]
    assert sorted(map(tuple, got.groupBy("doc_id").agg(F.sum("length")).collect())) == sorted(
        map(tuple, want.groupBy("doc_id").agg(F.sum("length")).collect()))
    assert set(cols) <= set(got.columns)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    odd = [(1, "same text here", None, "s", 1), (2, "same text here", "en", None, None), (None, None, None, None, None),
           (3, "", "en", "s", 0), (3, "", "en", "s", 0), (4, "x " * 50_000, "en", "s", 9), (None, "other words", "en", "s", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, fp int, kept int"
    docs = spark.createDataFrame([(*r, "r", 1, 2) for r in odd], schema)
    path = str(tmp_path / "odd")
    docs.write.parquet(path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}_sf/labels.parquet")
    step = spark.read.parquet(path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = cut_lineage(stage(spark, step, f"{path}_sf"))
        assert step.columns == docs.columns
    assert step.count() == 4
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, f"{path}_sf").count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
