"""WARC archives: exact round trip, other gzip members, broken input."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.shared import Scratch

PAGES = [(1, "http://a", "x" * 1500), (2, "http://b", "x" * 1500), (3, None, "é" * 600), (4, "http://d", None), (5, "http://e", ""), (6, "u v\r\nw", "small"), (7, "u", "small"), (9, "u", "x" * 1500), (10, "u", "<p>" + "long " * 90000), (None, "n", "y" * 2000), (None, "n", "y" * 2000), (11, "r", "z" * 1200), (11, "r", "z" * 1200)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, record_type string")
    folder = Scratch(spark, "t").path("a")
    paths = warc.write_archives(df, folder, archive_bytes=2000)
    assert paths.agg(F.sum("records")).first()[0] == len(PAGES)
    rows = warc.read_archives(paths).collect()
    assert len(rows) == len(PAGES) and all(r["valid"] for r in rows)
    large = {}
    for p, _, h in PAGES:
        if p is not None and h and len(h.encode()) >= 1000:
            large[h] = max(p, large.get(h, p))
    want = []
    for p, _, h in PAGES:
        data = (h or "").encode()
        again = p is not None and len(data) >= 1000 and large[h] != p
        want.append((f"urn:page:{'null' if p is None else p}", "revisit" if again else "response", f"urn:page:{large[h]}" if again else None, len(data), hashlib.sha1(data).hexdigest(), None if again else data))
    key = lambda x: (x[0], x[4])
    got = [(r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_one_member_a_record(spark):
    data = warc.record("response", "urn:page:1", "http://a", b"abc") + warc.record("revisit", "urn:page:2", None, b"abc", "urn:page:1")
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\n") == 2
    kinds = [h["warc-type"] for h, _ in warc.read_records(io.BytesIO(data), piece=7)]
    assert kinds == ["response", "revisit"]


@pytest.mark.parametrize("cut", [1, 9, 40])
def test_broken_archives(cut):
    data = warc.record("response", "urn:page:1", "http://a", b"abc" * 50)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-cut])))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"junk" + data)))


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none, Scratch(spark, "t").path("b"))).count() == 0
