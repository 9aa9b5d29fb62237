import gzip
import hashlib
import os

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from notewright.llm import warc
from notewright.llm.common import shared_folder
from notewright.llm.queries import ORACLES, QUERIES

BIG = "<p>é</p>" * 400


def local(path):
    return path.removeprefix("file:").replace("//", "/")


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id string, order long, target_uri string, date string, body string, payload string")


def test_round_trip_nulls_ties_and_odd_headers(spark):
    rows = [
        ("<urn:a>", 1, "http://x/\r\nWARC-Type: fake", "2024-01-01T00:00:00Z", BIG, "other"), ("<urn:b>", 5, None, None, BIG, None),
        ("<urn:c>", 5, "http://c", "d", BIG, None), ("<urn:d>", None, "http://d", "d", BIG, None), ("<urn:e>", 2, "http://e", "d", "small", None),
        ("<urn:f>", 3, "http://f", "d", "small", None), ("<urn:g>", 4, "http://g", "d", None, None), ("<urn:h>", 6, "ü", "d", "x" * 3_000_000, None),
    ]
    path = shared_folder(spark, "warc-test")
    warc.write(warc.deduplicated(records(spark, rows)), path)
    got = {r.record_id: r for r in warc.read(spark, path).collect()}
    assert len(got) == len(rows)
    for rid, _, uri, _, body, _ in rows:
        data = (body or "").encode()
        assert got[rid].payload_digest == hashlib.sha1(data).hexdigest() and got[rid].payload_bytes == len(data)
        assert got[rid].payload == (None if got[rid].record_type == "revisit" else data)
    assert {k for k, r in got.items() if r.record_type == "revisit"} == {"<urn:a>", "<urn:d>"}
    assert got["<urn:a>"].refers_to == "<urn:c>" and got["<urn:a>"].target_uri == "http://x/%0D%0AWARC-Type: fake"
    assert got["<urn:b>"].target_uri is None and got["<urn:h>"].target_uri == "ü"
    assert warc.read(spark, path).where(F.col("headers")["warc-record-id"] == "<urn:e>").count() == 1
    # every member is plain gzip to others
    files = [f for f in os.listdir(local(path)) if f.endswith(".gz")]
    text = b"".join(gzip.open(f"{local(path)}/{f}").read() for f in files)
    assert text.count(b"WARC/1.1\r\n") == len(rows)


def test_pushed_conditions_and_skipped_payloads(spark):
    path = shared_folder(spark, "warc-test")
    warc.write(warc.deduplicated(records(spark, [(f"<urn:{i}>", i, f"http://{i}", "d", BIG * 50 + str(i % 3), None) for i in range(30)])), path)
    assert warc.read(spark, path, payloads="false").where("record_type = 'revisit'").count() == 27
    assert warc.read(spark, path).where("target_uri in ('http://29', 'http://1')").count() == 2

    class Counting:
        def __init__(self, f):
            self.f, self.n = f, 0

        def read(self, n):
            data = self.f.read(min(n, 4096))
            self.n += len(data)
            return data

        def seek(self, at):
            self.f.seek(at)

    # incompressible payloads: what is not wanted is not read
    rows = [{"record_type": "response", "record_id": f"<{i}>", "date": "d", "target_uri": "u", "refers_to": None, "payload_digest": "00" * 20,
             "payload_bytes": 500_000, "payload": os.urandom(500_000)} for i in range(6)]
    data = b"".join(warc.member(warc.record_bytes(r)) for r in rows)
    import io
    f = Counting(io.BytesIO(data))
    found = list(warc.read_records(f, len(data), 0, lambda h: h["warc-record-id"] == "<3>", True))
    assert [p for _, p in found] == [rows[3]["payload"]] and f.n < 600_000
    # other writers' archives: plain, and gzip members without a length
    plain = b"\r\n".join(warc.record_bytes(r) for r in rows)
    other = b"".join(gzip.compress(warc.record_bytes(r)) for r in rows)
    for data in (plain, other):
        found = list(warc.read_records(io.BytesIO(data), len(data), 0, lambda h: h["warc-record-id"] in ("<0>", "<5>"), True))
        assert [p for _, p in found] == [rows[0]["payload"], rows[5]["payload"]]


def test_empty_table(spark):
    path = shared_folder(spark, "warc-test")
    warc.write(warc.deduplicated(records(spark, [])), path)
    assert warc.read(spark, path).count() == 0


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    n, wrong = differences(QUERIES["op6_warc"](spark, folder), connect(folder), ORACLES["op6_warc"])
    assert n == 250 and not wrong, wrong


def test_headers_of_any_length():
    import io
    import random

    r = random.Random(3)
    row = {"record_type": "response", "record_id": "<a>", "date": "d", "refers_to": None, "payload_digest": "00" * 20, "payload_bytes": 4, "payload": b"text"}
    for size in (10, 70_000, 1_200_000, 3_000_000):
        uri = "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=size))  # does not inflate in one step
        raw = warc.record_bytes({**row, "target_uri": uri})
        for data in (warc.member(raw) * 2, gzip.compress(raw) * 2, raw * 2):
            found = list(warc.read_records(io.BytesIO(data), len(data), 0, lambda h: h.get("warc-type") == "response", True))
            assert [(h["warc-target-uri"] == uri, p) for h, p in found] == [(True, b"text")] * 2
    cut = gzip.compress(warc.record_bytes({**row, "target_uri": "u"})[:60])
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(cut), len(cut), 0, lambda h: True, True))
