"""WARC round trips, revisits, skipping and foreign files."""

import gzip
import hashlib
import io
from base64 import b32encode

import pytest
from pyspark.sql import functions as F

from graphsift.llm import warc
from graphsift.session import shared_path

PAGES = [(1, "https://a.example/1", "<p>x</p>"), (2, "https://a.example/2", None), (3, "https://b.example/3", ""),
         (4, "https://a.example/4?a=b\r\nX: y", "é日本🙂"), (5, None, "<p>x</p>"), (9, "https://a.example/9", "<p>x</p>"),
         (6, "https://c.example/6", "z" * 300_000), (7, "https://c.example/7", "WARC/1.1\r\n\r\nfake"),
         (None, "https://n.example", "lonely"), (8, "https://r.example", "twice"), (8, "https://r.example", "twice")]


@pytest.fixture(scope="module")
def written(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES],
                                  "page_id bigint, url string, html string, payload string, n int").repartition(3)
    path = shared_path(spark, "test-warc")
    warc.write(pages, path, roll_bytes=1000)
    return path


def test_round_trip(spark, written):
    rows = warc.read(spark, written).collect()
    assert len(rows) == len(PAGES)
    html = {(i, u): (h or "").encode() for i, u, h in PAGES}
    for r in rows:
        uri = None if r.target_uri is None else r.target_uri.replace("%0D", "\r").replace("%0A", "\n")
        payload = html[r.page_id, uri]
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == b32encode(hashlib.sha1(payload).digest()).decode()
        assert bytes(r.payload) == (payload if r.warc_type == "response" else b"")


def test_revisits_refer_to_the_largest_id(spark, written):
    got = sorted(((r.page_id, r.warc_type, r.refers_to) for r in warc.read(spark, written, payload=False).collect()),
                 key=str)
    assert got == sorted([(1, "revisit", 9), (5, "revisit", 9), (9, "response", None), (2, "revisit", 3),
                          (3, "response", None), (4, "response", None), (6, "response", None),
                          (7, "response", None), (None, "response", None), (8, "response", None),
                          (8, "revisit", 8)], key=str)


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    types = {r.page_id: r.warc_type for r in warc.records(pages, min_revisit_bytes=6).collect()}
    assert types[1] == types[5] == "revisit" and types[2] == types[3] == types[9] == "response"


def test_filters_are_pushed_and_payloads_skipped(spark, written):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = warc.read(spark, written).where(
            (F.col("warc_type") == "response") & F.col("target_uri").startswith("https://c.example"))
        assert "warc_type" not in some._jdf.queryExecution().executedPlan().toString().split("Filter")[-1][:60]
        assert sorted(r.page_id for r in some.collect()) == [6, 7]
        assert [r.page_id for r in warc.read(spark, written).where("page_id in (4, 77)").collect()] == [4]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    only = warc.read(spark, written, types=["revisit"], payload=False)
    assert {r.page_id for r in only.collect()} == {1, 2, 5, 8}


class Stream(io.BytesIO):
    """Counts what is read of it."""

    taken = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def _record(page_id, body, kind="response"):
    row = {"page_id": page_id, "target_uri": "u", "warc_type": kind, "refers_to": None, "refers_to_uri": None,
           "payload_bytes": len(body), "sha1": hashlib.sha1(body).digest(), "payload": body}
    return warc.encode_record(row, "2024-01-01T00:00:00Z")


def test_rejected_records_are_not_inflated():
    import random
    body = random.Random(1).randbytes(1 << 20)
    data = b"".join(warc.gzip_member(_record(i, body)) for i in range(5))
    stream = Stream(data)
    rows = list(warc.read_records(stream, lambda r: r["page_id"] == 3, True))
    assert [r["payload"] for r in rows] == [body]
    assert stream.taken < 2 << 20 < len(data)
    assert gzip.decompress(data).count(b"WARC/1.1") >= 5           # any reader sees plain gzip members


def test_members_of_other_writers():
    data = b"".join(gzip.compress(_record(i, bytes([65 + i]) * 100_000)) for i in range(3))
    rows = list(warc.read_records(Stream(data), lambda r: r["page_id"] != 1, True))
    assert [(r["page_id"], r["payload"][:1], len(r["payload"])) for r in rows] == [(0, b"A", 100_000), (2, b"C", 100_000)]
    with pytest.raises(ValueError):
        list(warc.read_records(Stream(data[:-200]), lambda r: False, False))


BODIES = [b"", b"first\r\n\r\nWARC/1.1\r\n", b"x" * 300_000, "é日本".encode(), b"last"]


def test_members_of_many_records():
    whole = gzip.compress(b"".join(_record(i, b) for i, b in enumerate(BODIES)))
    plain = b"".join(_record(i, b) for i, b in enumerate(BODIES))
    for data in (whole, plain, whole + gzip.compress(_record(9, b"z")) + warc.gzip_member(_record(10, b"own"))):
        rows = list(warc.read_records(Stream(data), lambda r: True, True))
        assert [r["payload"] for r in rows][:5] == BODIES
        assert [r["payload"] for r in rows][5:] in ([], [b"z", b"own"])
        some = list(warc.read_records(Stream(data), lambda r: r["page_id"] in (1, 4), False))
        assert [(r["page_id"], r["payload"]) for r in some] == [(1, None), (4, None)]
    for cut in (whole[:-50], plain[:-10], plain[:len(plain) // 2]):
        with pytest.raises(ValueError):
            list(warc.read_records(Stream(cut), lambda r: True, True))


def test_folders_of_other_writers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(_record(i, b) for i, b in enumerate(BODIES))))
    (tmp_path / "sub" / "b.warc").write_bytes(b"".join(_record(10 + i, b) for i, b in enumerate(BODIES)))
    (tmp_path / "c.txt").write_bytes(b"no archive")
    (tmp_path / warc.FILE_NAME.format(0, "0a1b2c3d", 0)).write_bytes(b"of a write that did not end")
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in rows) == sorted(
        (k + i, b) for k in (0, 10) for i, b in enumerate(BODIES))


def test_payloads_of_the_whole_table(spark):
    """Every payload of pages is decoded; its length and digest are those of the header."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    path = shared_path(spark, "test-warc")
    warc.write(pages, path)
    kept = warc.read(spark, path).where("warc_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", F.unhex(F.sha1("payload")).alias("sha1"), F.length("payload").alias("n"),
        F.col("payload"))
    rows = kept.join(pages.select(F.col("page_id").alias("p"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("html")),
                     F.col("p") == F.col("page_id")).collect()
    assert len(rows) == kept.count() > 100
    for r in rows:
        assert bytes(r.payload) == bytes(r.html) and r.n == r.payload_bytes
        assert r.payload_digest == b32encode(bytes(r.sha1)).decode()


def test_empty_table(spark):
    path = shared_path(spark, "test-warc")
    warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read(spark, path).count() == 0
