"""Secret scans: the forest against pyspark.ml, held-out findings, redaction."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphsift.llm import secret_scan as s

WORDS = "the quick brown fox jumps over lazy dogs while seven wizards brew potions in the old tower".split()


@pytest.fixture(scope="module")
def forest(spark):
    docs = spark.createDataFrame([(i, " ".join(np.random.default_rng(i).choice(WORDS, 30))) for i in range(60)],
                                 "doc_id bigint, text string")
    return s.train(docs, findings=300)


def test_held_out_findings(forest):
    good = total = 0
    for seed in range(10_000, 10_150):
        for path, text, label in s.labelled_findings(WORDS, np.random.default_rng(seed)):
            for start, end in s.candidates(text):
                row = np.array([s.features(text, start, end, path, forest.words)])
                good += (forest.score(row)[0] >= 0.5) == bool(label)
                total += 1
    assert total > 800 and good / total > 0.95


def test_trees_vote_like_the_trained_model(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(1)
    x = rng.random((400, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    data = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y, strict=True)],
                                 "x array<double>, label double").select("x", array_to_vector("x").alias("features"),
                                                                         "label")
    model = RandomForestClassifier(numTrees=7, maxDepth=5, seed=1).fit(data)
    mine = s.Forest([s._tree_arrays(t.toDebugString) for t in model.trees], s.WordModel(np.zeros((28, 28)), frozenset()))
    for tree, arrays in zip(model.trees, mine.trees, strict=True):
        one = s.Forest([arrays], mine.words)
        got = [r.prediction for r in tree.transform(data).collect()]
        assert one.score(np.array([r.x for r in data.collect()])).tolist() == got


def test_candidates_are_maximal_and_do_not_overlap():
    text = 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y, password: correcthorse z 4952935900253052.'
    assert [text[a:b] for a, b in s.candidates(text)] == [
        "04dbebab91ab85687d33eeaaf9ac699e1188f962", "correcthorse", "4952935900253052"]
    long = "a1" * 100_000
    assert s.candidates(long) == [(0, 200_000)] and s.candidates("no digits here") == [] == s.candidates("")
    assert s.candidates("é1234567890123é") == [(1, 14)]


def test_assigned_values_and_test_paths():
    def found(text):
        return [text[a:b] for a, b in s.candidates(text)]
    assert found('password = "ab#cdef12345678901!xyz" and 4952935900253052') == [
        "ab#cdef12345678901!xyz", "4952935900253052"]
    assert found("passWord: correct#horse") == ["correct#horse"] == found("PassWord=correct#horse")
    assert found('pwd="a1b2c3d4e5f6g7#h1i2j3k4l5m6n7" x') == ["a1b2c3d4e5f6g7#h1i2j3k4l5m6n7"]
    # a run that begins before the value: one candidate, nothing lost
    assert found("x1token=abcdefgh1234#zz!") == ["x1token=abcdefgh1234#zz!"]
    for path in ("docker", "app/latest/x.py", "contest", "blocklist.txt", "clock", "sampler"):
        assert not s.TEST_PATHS.search(path), path
    for path in ("tests/a.py", "doc", "docs/x", "my_test.py", "README.md", "yarn.lock", "test2", "a-example"):
        assert s.TEST_PATHS.search(path), path


KEY = "9f8b1c04dbebab91ab85687d33eeaaf9ac699e11"
ROWS = [(1, f'see token = "{KEY}" there', "src1"), (2, "call 4952935900253052 now", "src1"), (3, None, "src1"),
        (4, "", None), (None, f"api_key = {KEY}", None), (1, f'see token = "{KEY}" there', "src1"),
        (5, f"TOKEN = \"{KEY.upper()}\"!! {'word ' * 50_000}", "src2")]


def test_scan_and_redact(spark, forest):
    docs = spark.createDataFrame([(*r, 1, "c") for r in ROWS],
                                 "doc_id bigint, text string, source string, score int, candidate string")
    found = s.scan(docs, forest).collect()
    assert sorted(((r.doc_id, r.candidate.lower() == KEY) for r in found if r.is_secret), key=str) == sorted(
        [(1, True), (1, True), (None, True), (5, True)], key=str)
    assert [r.candidate for r in found if not r.is_secret] == ["4952935900253052"]
    clean = s.redact(docs, forest)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    texts = {(r.doc_id, r.text and r.text[:40]) for r in clean.collect()}
    assert (1, 'see token = "[SECRET]" there') in texts and (None, "api_key = [SECRET]") in texts
    assert (2, ROWS[1][1]) in texts and (3, None) in texts and (4, "") in texts
    assert clean.where(F.lower("text").contains(KEY)).count() == 0


def test_words_and_pairs_of_all_texts(spark):
    """3,000 texts, each word in three of them: none is left out."""
    letters = "abcdefghij"
    word = ["zq" + "".join(letters[int(c)] for c in f"{i:04d}") for i in range(1000)]
    docs = spark.createDataFrame([(i, f"{word[i % 1000].title()} 7 ab {'x' * 20}") for i in range(3000)] + [(9999, None)],
                                 "doc_id bigint, text string")
    model, common = s.fit_words(docs)
    assert model.words == frozenset(word) and common[:2] == ["ab", "x" * 20] and len(common) == 1002
    counts = np.ones((28, 28))
    for text in [*word * 3, *["ab", "x" * 20] * 3000]:
        for a, b in zip(text, text[1:], strict=False):
            counts[s._kind(a), s._kind(b)] += 1
    assert np.allclose(model.pairs, np.log(counts / counts.sum(axis=1, keepdims=True)))
    assert s.fit_words(docs, min_share=0.3)[0].words == frozenset()


def test_empty_tables_and_no_findings(spark, forest):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert s.scan(docs, forest).count() == 0 and s.redact(docs, forest).count() == 0
    assert s.train(docs, findings=40).score(np.zeros((2, len(s.FEATURES)))).shape == (2,)
    none = spark.createDataFrame([], "path string, text string, label bigint")
    assert s.fit(none, forest.words).score(np.zeros((3, len(s.FEATURES)))).tolist() == [1.0, 1.0, 1.0]


def brute_candidates(text):
    """Maximal runs of 12 and more key characters with a digit, and assigned values; what overlaps is one."""
    spans = [m.span() for m in re.finditer(r"[A-Za-z0-9_+/=\-]+", text) if len(m[0]) >= 12 and re.search("[0-9]", m[0])]
    spans += [m.span(1) for m in re.finditer(
        r"(?i)(?:token|secret|password|passwd|pwd|api_?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{8,})", text)]
    out = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def test_candidates_against_brute_force():
    rng = np.random.default_rng(6)
    parts = ["token", "Secret", "pwd", "api_key", "apikey", "=", ": ", "\"", "'", " ", "  ", "abc", "9f8b1c", "0", "-", "_", "/+",
             "é", "#", "longletters", "\n", "!", "12345678901234", "auth"]
    seen = 0
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 25)))
        got = s.candidates(text)
        assert got == brute_candidates(text), text
        seen += len(got)
    assert seen > 1000


def test_a_score_at_the_threshold_is_accepted(spark, forest):
    docs = spark.createDataFrame([(1, f'see token = "{KEY}" there', "src1")], "doc_id bigint, text string, source string")
    score = s.scan(docs, forest).first().score
    assert s.scan(docs, forest, threshold=score).first().is_secret
    assert s.redact(docs, forest, threshold=score).first().text == 'see token = "[SECRET]" there'
    assert not s.scan(docs, forest, threshold=score + 1e-9).first().is_secret
