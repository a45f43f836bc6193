"""Archives at the edge, and reads of a part of the index."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_brute import bag
from wobble.llm import warc

LONG = "<p>" + "é" * 700


def expected(rows):
    """Page, payload bytes, digest, type and reference, by the contract."""
    datas = [((p, (h or "").encode())) for p, _, h in rows]
    largest = {}
    for p, d in datas:
        largest[d] = max(largest.get(d, -1), -1 if p is None else p)
    out = Counter()
    for p, d in datas:
        again = len(d) >= 1000 and largest[d] >= 0 and p != largest[d]
        out[p, len(d), hashlib.sha1(d).hexdigest(), "revisit" if again else "response", largest[d] if again else None] += 1
    return out


@pytest.fixture
def pages(spark):
    rows = [(1, "http://a", LONG), (5, "http://b", LONG), (None, None, LONG), (5, "http://b", LONG), (7, "u\r\nX: y", None), (8, "", ""), (9, None, "z" * 999), (10, None, "z" * 999)]
    rows += [(None, "http://n", "n" * 1000), (None, "http://n", "n" * 1000), (20, "http://c", "WARC/1.1\r\n\r\n" * 300), (21, "http://d", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return rows, df.select("*", *(F.lit("x").alias(c) for c in ("payload", "file", "offset", "length", "largest", "n", "d", "b")))


def test_edge_rows(pages):
    rows, df = pages
    assert bag(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_part_of_the_index(pages, spark, tmp_path):
    rows, df = pages
    index = warc.write_archives(df, f"file://{tmp_path}/w")
    some = index.where("page_id in (7, 20, 21)")
    got = {r.page_id: r for r in warc.read_records(some).collect()}
    assert {k: bytes(v.payload).decode() for k, v in got.items()} == {p: h or "" for p, _, h in rows if p in (7, 20, 21)}
    assert got[7].url == "u%0D%0AX: y"
    assert warc.read_records(index.limit(0)).count() == 0


def test_reads_are_joined_and_bounded():
    rows = [{"file": f, "offset": o, "length": n} for f, o, n in (("a", 0, 10), ("a", 15, 10), ("a", 200, 10), ("a", 205, 100), ("b", 0, 5))]
    assert list(warc.spans(rows, gap=20, most=100)) == [("a", 0, 25, [(0, 10), (15, 10)]), ("a", 200, 210, [(200, 10)]), ("a", 205, 305, [(205, 100)]), ("b", 0, 5, [(0, 5)])]
    assert list(warc.spans([])) == []


def test_tasks_follow_bytes(pages, tmp_path, monkeypatch):
    _, df = pages
    index = warc.write_archives(df, f"file://{tmp_path}/w")
    monkeypatch.setattr(warc, "TASK", 500)
    total = index.agg(F.sum("length")).first()[0]
    assert warc.read_records(index).rdd.getNumPartitions() >= total // 1000 > 1


def test_false_records_are_refused(spark, pages, tmp_path):
    _, df = pages
    good = warc._record({"page_id": 1, "url": "u", "payload": b"abc", "payload_bytes": 3, "payload_digest": hashlib.sha1(b"abc").hexdigest(), "record_type": "response", "refers_to": None})
    assert warc.parsed(good)["payload"] == b"abc"
    for bad in (good.replace(b"abc", b"abd"), good[:-1], b"x" + good):
        with pytest.raises(ValueError):
            warc.parsed(bad)
