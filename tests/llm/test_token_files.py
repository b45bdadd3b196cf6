"""Bit-packed token files: exact round trips, order, random access, damage."""

import io
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphsift.llm import token_files as tf
from graphsift.session import shared_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [*[(i, f"doc {i} " * (i % 40)) for i in range(300, 0, -1)], (-5, "negative"), (None, "no id"), (None, None),
        (7, "again"), (7, "again"), (7, ""), (1000, "long " * 60_000), (1001, "日本 🙂 <|endoftext|> ñ"), (1002, None)]


@pytest.fixture(scope="module")
def expected():
    """Rows in order with their ids, by the named library."""
    exact = Tokenizer.from_file(VOCABULARY)
    rows = [(i, [*exact.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in ROWS]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def written(spark):
    docs = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in ROWS],
                                 "doc_id bigint, text string, start int, ids string, by_text int").repartition(5)
    path = shared_path(spark, "test-tokens")
    tf.write(docs, path, VOCABULARY, end_id=2, block_ids=256, roll_bytes=40_000)
    return path


@pytest.mark.parametrize("width", [1, 2, 7, 13, 16, 17, 31, 32])
def test_bits_of_any_width(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        data = tf.pack_bits(ids, width)
        assert len(data) == -(-n // 64) * 8 * width
        assert tf.unpack_bits(data, width, n).tolist() == ids.tolist()
        bits = "".join(f"{int(i):0{width}b}"[::-1] for i in ids)        # the format, bit by bit
        assert "".join(f"{b:08b}"[::-1] for b in data)[:len(bits)] == bits
    with pytest.raises(ValueError):
        tf.pack_bits(np.array([1 << width], np.uint64), width)
    assert tf.bit_width((1 << width) - 1) == width


def test_width_is_the_vocabularys():
    assert tf.max_id(VOCABULARY) == 50256 and tf.bit_width(50256) == 16


def test_random_access_within_a_file():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 5, 700, 1, 64, 3000, 0)]
    sink = io.BytesIO()
    sink.close = lambda: None
    out = tf.FileWriter(sink, 13, 128)
    for k, ids in enumerate(docs):
        out.add(None if k == 0 else 10 * k, ids)
    out.close()
    file, whole = tf.TokenFile(io.BytesIO(sink.getvalue())), np.concatenate(docs)
    for a, b in [(0, 0), (0, len(whole)), (127, 129), (128, 256), (700, 701), (len(whole) - 1, len(whole))]:
        assert file.ids(a, b).tolist() == whole[a:b].tolist()
    assert file.rows_of([30, 10, 11, 30, 60]).tolist() == [1, 3, 6]
    with pytest.raises(IndexError):
        file.ids(0, len(whole) + 1)
    for at in (20, len(sink.getvalue()) - 30):
        bad = bytearray(sink.getvalue())
        bad[at] ^= 1
        with pytest.raises(ValueError):
            tf.TokenFile(io.BytesIO(bytes(bad))).ids(0, 10)


def test_round_trip_in_order(spark, written, expected):
    rows = sorted(tf.read(spark, written).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [i for i, _ in expected]
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows)
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert got == sorted((str(i), ids) for i, ids in expected)


def test_digests_and_single_documents(spark, written, expected):
    some = [7, 1000, 55, 4711]
    rows = tf.read(spark, written, doc_ids=some).select("doc_id", "start", F.crc32("ids").alias("c")).collect()
    want = sorted((i, crc32(np.array(ids, "<u4").tobytes())) for i, ids in expected if i in some)
    assert sorted((r.doc_id, r.c) for r in rows) == want
    places = {(r.doc_id, r.start) for r in tf.read(spark, written, ids=False).collect()}
    assert {(r.doc_id, r.start) for r in rows} <= places and len(places) == len(ROWS)


def test_empty_table(spark):
    path = shared_path(spark, "test-tokens")
    tf.write(spark.createDataFrame([], "doc_id bigint, text string"), path, VOCABULARY, end_id=2)
    assert tf.read(spark, path).count() == 0
