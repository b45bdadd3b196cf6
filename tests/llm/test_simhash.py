"""SimHash: fingerprints and components against brute force."""

import re

import pytest
import xxhash
from pyspark.sql import functions as F

from graphsift.llm import simhash


def brute_fingerprint(text, shingle=3):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    runs = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, max_bits=3):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    part = list(range(len(fps)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= max_bits:
                part[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, f"{fp:016x}", low.get(find(k))) for k, (i, fp) in enumerate(fps)), key=str)


def texts():
    base = [f"w{(i * 7919) % 613}" for i in range(220)]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper())]
    for k in range(40):                                    # one word changed, ever further along
        near = list(base)
        near[(k * 5) % len(near)] = f"x{k % 3}"
        rows.append((10 + k, " ".join(near)))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "one two"), (105, "ONE TWO"),
             (106, "a\x1cb c\xa0d É é"), (None, "one"), (1, " ".join(base)), (107, "ß " * 5000)]
    return rows


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in texts()],
                                 "doc_id bigint, text string, fp int, component_id string, a int")
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint().alias("fp"), "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(texts())


def test_masks_find_every_pair_within_the_distance():
    masks = simhash.block_masks(6, 3)
    assert len(masks) == 20
    for bits in ([0, 1, 2], [0, 20, 63], [10, 11, 33], [5], [62, 63, 61]):
        differ = sum(1 << b for b in bits)
        assert any(differ & (m % (1 << 64)) == 0 for m in masks)
    with pytest.raises(ValueError):
        simhash.block_masks(3, 3)


def test_other_lengths_and_distances(spark):
    docs = spark.createDataFrame(texts(), "doc_id bigint, text string")
    for shingle, bits in ((1, 0), (5, 6)):
        got = {r.doc_id: r.fp for r in simhash.fingerprints(docs, shingle=shingle).collect()}
        assert got[1] % (1 << 64) == brute_fingerprint(texts()[0][1], shingle)
        assert simhash.near_duplicates(docs, shingle=shingle, max_bits=bits, blocks=9).count() == len(texts())


def test_long_text_is_counted_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == whole


def test_keep_one(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id bigint, text string, number string")
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns
    groups = {c for _, _, c in brute_components(rows)}
    assert sorted(r.doc_id for r in left.collect()) == sorted(groups)
    unique = docs.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    assert sorted(r.doc_id for r in simhash.keep_one(unique).collect()) == sorted(groups)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0
