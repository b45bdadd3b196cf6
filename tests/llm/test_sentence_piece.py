"""SentencePiece sampling: lossless, reproducible, and distributed as it should be."""

from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from graphsift.llm import sentence_piece as s

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello  world", "a\nb", "x▁y ▁▁ z", " lead", "日本 ê 𝔘𝔫", "\t tab\r\n\n", None, "", "   ", "x" * 5000,
         "naïve façade", "\x00\x1f﻿", "word " * 20_000]


@pytest.fixture(scope="module")
def vocabulary():
    return s.Vocabulary(MODEL)


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_lossless_also_for_the_library(vocabulary):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = s.Sampler(vocabulary).encode(list(range(len(TEXTS))), TEXTS)
    for text, raw in zip(TEXTS, encoded, strict=True):
        assert s.decode_ids(raw, vocabulary.as_bytes) == (text or "")
        if text and "▁" not in text:
            assert library.decode(ids_of(raw)) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text_is_lossless(texts):
    vocabulary = test_any_text_is_lossless.vocabulary
    for text, raw in zip(texts, s.Sampler(vocabulary).encode(list(range(len(texts))), texts), strict=True):
        assert s.decode_ids(raw, vocabulary.as_bytes) == text


test_any_text_is_lossless.vocabulary = s.Vocabulary(MODEL)


def brute(vocabulary, segment):
    """Probability of every segmentation of a segment."""
    out = {}
    for cuts in product([0, 1], repeat=len(segment) - 1):
        edges = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(segment)]
        parts = [segment[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        if all(p in vocabulary.weights for p in parts):
            out[tuple(vocabulary.weights[p][0] for p in parts)] = np.prod([vocabulary.weights[p][1] for p in parts])
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_samples_follow_the_lattice_distribution():
    vocabulary = s.Vocabulary(MODEL, alpha=0.3)
    n = 20_000
    encoded = s.Sampler(vocabulary).encode(list(range(n)), ["there"] * n)
    seen, expected = Counter(tuple(ids_of(r)) for r in encoded), brute(vocabulary, "▁there")
    assert set(seen) <= set(expected) and len(seen) > 5
    assert sum(abs(seen[k] / n - p) for k, p in expected.items()) < 0.05


def test_long_and_short_segments_have_the_same_lattices(vocabulary, monkeypatch):
    words = ["▁" + w for w in ("there", "unbelievable", "été", "x", "日本語", "a" * 40)] + ["\n", "▁▁▁"]
    tables = []
    for limit in (48, 0):
        monkeypatch.setattr(s, "SHORT", limit)
        lattices = s.Lattices(vocabulary)
        lattices.add_all(words)
        shape = {}
        for w in words:
            stack, found = [lattices.end_node[w]], []
            a, b = lattices.first[stack[0]], lattices.first[stack[0] + 1]
            found = sorted(zip(lattices.piece[a:b].tolist(),
                               np.diff(lattices.upto[a:b], prepend=0).round(5).tolist(), strict=True))
            shape[w] = found
        tables.append(shape)
    for w in words:
        assert [p for p, _ in tables[0][w]] == [p for p, _ in tables[1][w]]
        assert np.allclose([q for _, q in tables[0][w]], [q for _, q in tables[1][w]], atol=1e-4)


def test_jobs_are_reproducible(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no key", "x"), (3, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    a = s.encode(docs.repartition(1), MODEL, sub_batch=3).collect()
    b = s.encode(docs.repartition(5), MODEL).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
    other = s.encode(docs, MODEL, alpha=0.1, seed=8).collect()
    assert sorted(map(tuple, a), key=str) != sorted(map(tuple, other), key=str)
    back = s.decode(s.encode(docs, MODEL, keep=["text"]), MODEL)
    assert back.count() == back.where("decoded = coalesce(text, '')").count() == len(rows)
    assert s.encode(docs.limit(0), MODEL).count() == 0
