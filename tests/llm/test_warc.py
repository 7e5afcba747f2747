"""WARC: exact round trips, pushed filters, headers first, stepping over records."""

import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from keelson.llm import warc


def brute(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= warc.SMALLEST and p is not None:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = b in first and first[b] != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/", "x" * 200), (2, "http://b/", "x" * 200), (0, "http://c/\r\nX: y", "x" * 200), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""),
    (7, "é", "é" * 50), (8, "e", "é" * 50), (9, "r", "\r\n\r\nbody" * 40), (None, "n", "x" * 200), (10, "big", "long page " * 300_000), (1, "http://a/", "x" * 200), (-4, "%0A", "z" * 150),
]


@pytest.fixture(scope="module")
def folder(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3).withColumns({"digest": F.lit(1), "first": F.lit(2)})
    return warc.archive(df)


def test_round_trip(spark, folder):
    got = warc.digests(warc.read(spark, folder)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(ROWS)
    urls = {r.record_id: r.target_uri for r in warc.read(spark, folder, payload=False).collect()}
    assert urls["<urn:page:0>"] == "http://c/%0D%0AX: y" and urls["<urn:page:3>"] is None and urls["<urn:page:-4>"] == "%0A"


def test_pushdown(spark, folder):
    df = warc.read(spark, folder).where((F.col("record_type") == "revisit") & F.col("target_uri").isNotNull())
    assert {r.record_id for r in df.collect()} == {"<urn:page:1>", "<urn:page:2>", "<urn:page:8>", "<urn:page:>"}
    some = warc.read(spark, folder).where(F.col("record_id").isin("<urn:page:9>", "<urn:page:6>"))
    assert {bytes(r.payload) for r in some.collect()} == {b"", b"\r\n\r\nbody" * 40}
    long = warc.read(spark, folder).where("payload_length > 1000000")
    assert [r.record_id for r in long.collect()] == ["<urn:page:10>"]


class Counting(io.BytesIO):
    bytes_read = 0

    def read(self, n=-1):
        out = super().read(n)
        Counting.bytes_read += len(out)
        return out


def record(i, body):
    fields = {"record_id": f"<urn:page:{i}>", "record_type": "response", "target_uri": "u", "payload_digest": None, "refers_to": None, "payload_length": len(body)}
    return warc.record(fields, body, "2000-01-01T00:00:00Z")


def test_headers_first_and_skipping():
    bodies = [random.Random(i).randbytes(100_000) for i in range(5)]
    data = b"".join(warc.member(record(i, b)) for i, b in enumerate(bodies))
    assert gzip.decompress(data).count(b"WARC/1.1") == 5
    Counting.bytes_read = 0
    heads = list(warc.Stream(Counting(data)).records(lambda h: True, False))
    assert len(heads) == 5 and all(p is None for _, p in heads)
    assert Counting.bytes_read < len(data) / 2
    picked = list(warc.Stream(io.BytesIO(data)).records(lambda h: h["WARC-Record-ID"] == "<urn:page:3>", True))
    assert [p for _, p in picked] == [bodies[3]]


def test_plain_gzip_members():
    bodies = [b"a" * 5000, b"", b"b\r\n\r\n"]
    data = b"".join(gzip.compress(record(i, b)) for i, b in enumerate(bodies))
    assert [p for _, p in warc.Stream(io.BytesIO(data)).records(lambda h: True, True)] == bodies


def foreign(i, body, kind="response"):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" if kind == "response" else b""
    media = b"application/http; msgtype=response" if kind == "response" else b"application/warc-fields"
    block = http + body
    return b"WARC/1.0\r\nwarc-type: %s\r\nWARC-Record-ID: <urn:uuid:%d>\r\nWARC-Target-URI:http://h/%d\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind.encode(), i, i, media, len(block), block)


def test_archives_of_others(spark, tmp_path):
    bodies = [b"", b"a\r\n\r\nb", b"x" * 300_000, "é".encode() * 70_000, random.Random(1).randbytes(200_000), b"WARC/1.0\r\n\r\n"]
    records = [foreign(0, b"software: x\r\n", "warcinfo")] + [foreign(i + 1, b) for i, b in enumerate(bodies)]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    with gzip.GzipFile(tmp_path / "named.warc.gz", "wb") as f:
        f.write(b"".join(records))
    (tmp_path / "notes.txt").write_text("no archive")
    (tmp_path / f"{'0' * 12}-{'1' * 12}-00000.warc.gz").write_bytes(b"left behind by a lost task")
    own = spark.createDataFrame([(77, "u", "own" * 50)], "page_id long, url string, html string")
    for _ in range(2):
        warc.archive(own, str(tmp_path))  # two jobs, two manifests
    df = warc.read(spark, str(tmp_path))
    got = df.where("record_type = 'response' AND record_id != '<urn:page:77>'").collect()
    assert sorted((r.record_id, r.target_uri, bytes(r.payload), r.payload_length) for r in got) == sorted((f"<urn:uuid:{i + 1}>", f"http://h/{i + 1}", b, len(b)) for i, b in enumerate(bodies) for _ in range(4))
    assert df.where("record_type = 'warcinfo'").count() == 4 and df.where("record_id = '<urn:page:77>'").count() == 2
    assert {bytes(r.payload) for r in df.where("record_type = 'warcinfo'").collect()} == {b"software: x\r\n"}
    one = warc.read(spark, str(tmp_path / "plain.warc"), payload=False)
    assert [(r.payload_length, r.payload) for r in one.where("record_id = '<urn:uuid:3>'").collect()] == [(300_000, None)]
    assert "PushedFilters: [EqualTo" in df.where("record_id = 'x'")._jdf.queryExecution().executedPlan().toString() or "record_id" in df.where("record_id = 'x'")._jdf.queryExecution().executedPlan().toString()


def test_plain_archives_are_passed_by_seeks():
    data = b"".join(foreign(i, random.Random(i).randbytes(1_000_000)) for i in range(5))
    Counting.bytes_read = 0
    assert len(list(warc.Stream(Counting(data)).records(lambda h: True, False))) == 5
    assert Counting.bytes_read < len(data) / 5


@pytest.mark.parametrize("cut", [10, 200, 5000])
def test_cut_archives_are_errors(cut):
    data = foreign(1, b"x" * 20_000)
    for raw in (data[:-cut], gzip.compress(data[:-cut]), warc.member(record(1, b"y" * 20_000))[:-60]):
        if cut > 10 or raw[:2] == b"\x1f\x8b" and raw[3] == 4:
            with pytest.raises((EOFError, ValueError)):
                list(warc.Stream(io.BytesIO(raw)).records(lambda h: True, True))


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.digests(warc.read(spark, warc.archive(df))).collect() == []
