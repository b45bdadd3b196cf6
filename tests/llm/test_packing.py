"""Packing: ids against ``tokenizers``, whole documents, full sequences."""

from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphsift.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "a", "Hello  world\n\n it's 12345 ñandú 日本 🙂", "<|endoftext|> inside", "x" * 30_000,
         "word " * 9000, "tab\tand\rreturn \x00  ", *[f"doc {i} " * (i % 50) for i in range(200)]]


@pytest.fixture(scope="module")
def packed(spark):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)],
                                 "doc_id bigint, text string, ids int, offset int").repartition(3)
    return packing.pack(docs, VOCABULARY, group_tokens=20_000).collect()


def test_documents_are_whole_and_ids_right(packed):
    exact = Tokenizer.from_file(VOCABULARY)
    by_doc = {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
        assert ids == [*exact.encode(text or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist()
        assert {r.doc_tokens for r in pieces} == {len(ids)}
        assert all(r.length == len(r.ids) // 4 for r in pieces)


def test_sequences_are_gapless_and_unpadded(packed):
    by_seq = {}
    for r in packed:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in pieces])
        assert [r.offset for r in pieces] == [0, *ends[:-1].tolist()]
        total = int(ends[-1])
        assert total <= 2048 and total & (total - 1) == 0


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 700, 3000).tolist()
    pieces = packing.assign(lengths, 2048)
    cost = {}
    for _, _, n, seq, _ in pieces:
        cost[seq] = cost.get(seq, 0) + n + n * n / 2048
    full = [c for seq, c in cost.items() if sum(p[2] for p in pieces if p[3] == seq) == 2048]
    first_fit, room, costs = [], 0, []
    for n in lengths:                                   # in the order of arrival
        while n:
            room = room or (costs.append(0) or 2048)
            take = min(n, room)
            costs[-1] += take + take * take / 2048
            n, room = n - take, room - take
    first_fit = costs[:-1]
    assert np.std(full) < 0.5 * np.std(first_fit)


def test_assignment_by_brute_force():
    """Documents that fit are whole, in the cheapest sequence with room for them at their turn."""
    rng = np.random.default_rng(2)
    for n, top in ((1, 5), (40, 30), (60, 200), (80, 64)):
        lengths, cap = rng.integers(1, top, n).tolist(), 64
        pieces = packing.assign(lengths, cap)
        whole = {d: (s, n, q) for d, s, n, q, _ in pieces if n == lengths[d]}
        runs = sum(x // cap for x in lengths)
        total = sum(lengths) - runs * cap
        room = dict(enumerate([cap] * (total // cap) + [1 << b for b in range(6, -1, -1) if total % cap >> b & 1], runs))
        cost = dict.fromkeys(room, 0.0)
        for length, d in sorted(((x, d) for d, x in enumerate(lengths) if x < cap), key=lambda x: (-x[0], x[1])):
            fits = [q for q, r in room.items() if r >= length]
            if not fits:
                continue
            best = min(fits, key=lambda q: (cost[q], q))
            assert whole[d][2] == best
            room[best] -= length
            cost[best] += length + length * length / cap
        covered = sorted((d, s, s + n) for d, s, n, _, _ in pieces)
        assert sum(b - a for _, a, b in covered) == sum(lengths)
        assert all(a[0] != b[0] or a[2] == b[1] for a, b in zip(covered, covered[1:], strict=False))


def test_short_documents_stay_whole_beside_long_ones():
    rng = np.random.default_rng(4)
    lengths = [*rng.integers(1, 2048, 900).tolist(), *rng.integers(2048, 20_000, 100).tolist()]
    cut = {d for d, _, n, _, _ in packing.assign(lengths, 2048) if n < lengths[d] < 2048}
    assert not cut


def test_fast_encoder_equals_tokenizers_for_every_code_point():
    encode, exact = packing.encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 1 << 16):
        texts = [f"ab{chr(c)}c 1{chr(c)} {chr(c)}{chr(c)}  {chr(c)}\n" for c in points[at:at + (1 << 16)]]
        expected = exact.encode_batch(texts, add_special_tokens=False)
        assert all(encode(t).tolist() == e.ids for t, e in zip(texts, expected, strict=True))


def test_ids_do_not_depend_on_partitions(spark, packed):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").coalesce(1)
    again = packing.pack(docs, VOCABULARY).collect()
    crc = {}
    for r in again:
        crc.setdefault(r.doc_id, []).append((r.start, r.ids))
    for r in packed:
        whole = b"".join(x for _, x in sorted(crc[r.doc_id]))
        assert crc32(whole[4 * r.start:4 * (r.start + r.length)]) == crc32(r.ids)


def test_null_and_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id bigint, text string").coalesce(1)
    rows = packing.pack(docs, VOCABULARY, capacity=4).collect()
    assert sum(r.length for r in rows) == 9 and {r.doc_id for r in rows} == {None, 1}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(empty, VOCABULARY).count() == 0
