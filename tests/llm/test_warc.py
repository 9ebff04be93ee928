"""Archives: round trips, filters, and what is skipped."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from glossa.llm import warc

BIG, SMALL = "<p>é" + "x" * 1200, "y" * 900
PAGES = [(1, "http://a/1\n2", BIG), (5, "http://a/5", BIG), (3, None, BIG), (3, None, BIG), (7, "http://a/7", SMALL), (8, "http://a/8", SMALL), (9, "u", None), (10, "u", ""), (None, "u", BIG), (None, None, "z" * 2000), (None, "v", "z" * 2000), (11, "\r\nWARC-Type: x", "a\r\n\r\nb")]


def test_query(spark):
    rows = warc.query(spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)).collect()
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in rows)
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        kind = "revisit" if html == BIG and page != 5 else "response"
        want.append((page or -1, len(data), hashlib.sha1(data).hexdigest(), kind, 5 if kind == "revisit" else -1))
    assert got == sorted(want)


def test_empty_table(spark):
    assert warc.query(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_payloads_and_pushed_filters(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    back = warc.archived(pages, f"file://{tmp_path}/a")
    texts = {r.page_id: r.payload for r in back.where("page_id IN (5, 7, 11)").collect()}
    assert {k: v.decode() for k, v in texts.items()} == {5: BIG, 7: SMALL, 11: "a\r\n\r\nb"}
    plan = back.where((F.col("page_id") >= 7) & F.col("target_uri").startswith("http://a/"))
    assert sorted(r.page_id for r in plan.collect()) == [7, 8]
    heads = spark.read.format("warc").schema("record_type string, page_id long").option("path", f"file://{tmp_path}/a").load()
    assert heads.where("record_type = 'warcinfo'").count() >= 1


@pytest.mark.parametrize("shape", [warc.member, gzip.compress, bytes])
def test_unwanted_payloads_are_not_inflated(shape, monkeypatch):
    digest = "0" * 40
    kept = [warc.record("response", k, f"http://a/{k}", bytes([65 + k]) * 300_000, digest, 300_000, None, "d") for k in range(4)]
    data = b"".join(shape(x) for x in kept)
    asked = []
    real = warc._Member.need
    monkeypatch.setattr(warc._Member, "need", lambda self, n: (asked.append(n), real(self, n))[1])
    found = list(warc.records(io.BytesIO(data), len(data), lambda row: row["page_id"] == 2, True))
    assert [(r["page_id"], p) for _, r, p in found] == [(2, b"C" * 300_000)]
    if shape is warc.member:
        assert sum(n > 2000 for n in asked) == 1
    assert len(list(warc.records(io.BytesIO(data), len(data), lambda row: True, False))) == 4
