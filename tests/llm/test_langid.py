"""Language identification: held-out accuracy, rejection, edge cases."""

import numpy as np

from graphsift.llm import langid

WORDS = {"en": "the and of that with from this have which were their would there about people into time",
         "de": "der und die nicht eine auch sich werden dass über können haben durch wenn noch schon zwischen",
         "fr": "les des une dans pour que avec sur pas plus par mais comme tout être cette faire nous"}


def texts(n, seed, langs=WORDS):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS[lang].split(), 40)) + f"!! {i}", lang, "x")
            for i, lang in enumerate(rng.choice(sorted(langs), n))]


SCHEMA = "doc_id bigint, text string, lang string, score string"


def test_held_out_accuracy_and_edges(spark):
    model = langid.fit(spark.createDataFrame(texts(300, 1), SCHEMA), max_per_lang=50, clusters=3)
    assert set(model.langs) == set(WORDS) and len(model.langs) == 9
    odd = [(900, None, None, ""), (901, "", None, ""), (902, "12 %% 4", None, ""), (None, "the people", None, ""),
           (903, "日本語のテキスト" * 30, None, ""), (904, "the and of that " * 100_000, None, "")]
    test = texts(200, 2)
    got = {(r.doc_id): r for r in langid.identify(spark.createDataFrame(test + odd, SCHEMA), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in test]) > 0.97
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[None].lang_pred == "en" and got[904].lang_pred == "en"
    assert got[903].rejected and not got[0].rejected
    assert all(0 <= r.score <= 1 for r in got.values())


def test_prediction_is_the_nearest_centroid():
    rng = np.random.default_rng(0)
    model = langid.LanguageModel(["a", "b", "b"], rng.random(langid.DIM).astype(np.float32),
                                 langid._unit(rng.random((3, langid.DIM)).astype(np.float32)), np.ones(3))
    for text in ("hello there", "ÀÉ x", "zz top"):
        tf = np.zeros(langid.DIM)
        raw = [b if b > 0x7f or 97 <= b <= 122 else 32 for b in f" {text} ".lower().encode()]
        raw = [b for k, b in enumerate(raw) if not (k and b == 32 == raw[k - 1])]
        for n in (2, 3):
            for k in range(len(raw) - n + 1):
                gram = int.from_bytes(bytes(raw[k:k + n]), "big") + ((1 << 24) if n == 3 else 0)
                tf[gram * 2654435761 % 2 ** 32 >> 20] += 1
        vector = np.log1p(tf) * model.idf
        cosines = model.centroids @ vector / np.linalg.norm(vector)
        [(lang, score, _)] = model.predict([text])
        assert lang == model.langs[int(cosines.argmax())] and abs(score - cosines.max()) < 1e-5


def test_long_texts_are_counted_in_chunks(monkeypatch):
    text = "Übung macht den Meister " * 500
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", 100)
    assert (langid.counts(text) == whole).all()


def test_nothing_to_learn_from(spark):
    rows = [(1, "text", None, ""), (2, None, "en", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert {r.lang_pred for r in got} == {"und"}
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).count() == 0
