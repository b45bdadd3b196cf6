"""Ordinal regression: likelihood, held-out grades, edge cases."""

import numpy as np

from graphsift.llm import toxicity


def sample(n, seed):
    """Grade = number of insults (0 to 2) among harmless words."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        grade = int(rng.integers(0, 3))
        words = [f"word{k}" for k in rng.integers(0, 200, int(rng.integers(5, 200)))]
        words += list(rng.choice(["idiot", "moron", "scumbags"], 3 * grade))
        rng.shuffle(words)
        rows.append((i, " ".join(words), grade))
    return rows


def test_held_out_grades(spark):
    rows = sample(800, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id bigint, text string, grade string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(5, None), (None, 2), (9999, 1)],
                                   "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert np.all(np.diff(model.thresholds) > 0) and len(model.thresholds) == 2
    test = sample(300, 2)
    frame = spark.createDataFrame([(i, t) for i, t, _ in test] + [(900, None), (901, ""), (None, "moron idiot idiot")],
                                  "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert np.mean([got[i].grade == g for i, _, g in test]) > 0.95
    assert not got[900].toxic and got[900].severity == got[901].severity < 0.6 and got[None].toxic
    order = np.argsort([got[i].severity for i, _, _ in test])
    grades = np.array([g for _, _, g in test])[order]
    assert grades[:60].mean() < 0.1 and grades[-60:].mean() > 1.9


def test_fit_lowers_the_penalised_loss():
    rows = sample(300, 3)
    data = toxicity.Rows.of([toxicity.features(t) for _, t, _ in rows])
    y = np.array([g for _, _, g in rows])

    def loss(model):
        total = 0.0
        sizes = np.where(y == 0, (y == 0).sum(), (y > 0).sum()) ** -0.9
        for (_, text, g), w in zip(rows, sizes / sizes.sum(), strict=True):
            above = 1 / (1 + np.exp(model.thresholds - model.margin(text)))
            probs = np.concatenate([[1], above]) - np.concatenate([above, [0]])
            total -= w * np.log(max(probs[g], 1e-12))
        return total + 2e-3 * sum(abs(v) for v in model.weights.values())
    losses = [loss(toxicity.fit_ordinal(data, y, rounds=r)) for r in (1, 20, 200)]
    assert losses[0] > losses[1] > losses[2]


def test_two_labels_become_three_grades():
    rows = sample(400, 4)
    data = toxicity.Rows.of([toxicity.features(t) for _, t, _ in rows])
    truth = np.array([g for _, _, g in rows])
    grades = toxicity.split_grades(data, (truth > 0).astype(int))
    assert (grades == truth).mean() > 0.9


def test_without_labels_and_with_one_grade(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    one = toxicity.fit(docs, spark.createDataFrame([(1, 3)], "doc_id bigint, toxic int"))
    assert {r.severity for r in toxicity.score(docs, none).collect()} == {0.0}
    assert {r.severity for r in toxicity.score(docs, one).collect()} == {3.0}
    assert toxicity.score(docs.limit(0), none).count() == 0
    assert toxicity.drop_toxic(docs, none).count() == 2


def test_remembered_words_change_nothing(monkeypatch):
    model = toxicity.OrdinalModel({k: 0.5 for k in toxicity.features("idiot moron")}, np.array([1.0]))
    before = model.margin("idiot a b c moron idiot")
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 2)
    assert model.margin("idiot a b c moron idiot") == before > 0


def test_held_out_labels_of_the_given_documents(spark):
    """Fitted on four fifths of the labels of sf0.1, scored on the documents of the others."""
    from pyspark.sql import functions as F
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic IS NOT NULL")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(docs, labels.where(~held))
    rows = toxicity.score(docs.join(labels.where(held).select("doc_id"), "doc_id", "left_semi"), model)
    got = rows.select("doc_id", F.col("toxic").alias("found")).join(labels.select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    toxic, clean = [r.found for r in got if r.truth == 1], [r.found for r in got if r.truth == 0]
    print(f"{len(toxic)} toxic, {np.mean(toxic):.3f} found; {len(clean)} clean, {np.mean(clean):.4f} rejected")
    assert len(toxic) >= 20 and np.mean(toxic) > 0.85 and np.mean(clean) < 0.01


def test_equal_and_very_long_texts(spark):
    rows = sample(200, 7)
    model = toxicity.fit_ordinal(toxicity.Rows.of([toxicity.features(t) for _, t, _ in rows]), np.array([g for _, _, g in rows]))
    long = "word1 word2 " * 100_000 + "moron idiot scumbags " * 1000
    docs = spark.createDataFrame([(1, long), (2, "moron idiot"), (2, "moron idiot"), (3, "moron idiot")], "doc_id bigint, text string")
    got = toxicity.score(docs, model).collect()
    assert len(got) == 4 and len({r.severity for r in got if r.doc_id != 1}) == 1
    assert next(r for r in got if r.doc_id == 1).toxic
