import base64
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from trafficlens.llm import warc as w
from trafficlens.session import shared_path


def _archive(*records):
    return io.BytesIO(b"".join(w.gzip_member(r) for r in records))


def test_reader_frames_and_verifies():
    payload = ("é" * 400_000 + "\r\n\r\nWARC/1.1\r\n").encode()
    good = w.record(5, "http://x/ü\r\nX: y", payload, None)
    got = list(w.read_archive(_archive(good, w.record(6, None, payload, 5), w.record(None, "", b"", None))))
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert [r["record_type"] for r in got] == ["response", "revisit", "response"]
    assert [r["payload_bytes"] for r in got] == [len(payload), len(payload), 0]
    assert got[0]["payload_digest"] == got[1]["payload_digest"] == digest
    assert got[1]["refers_to"] == "5" and got[0]["refers_to"] is None and got[2]["page_id"] is None
    for bad in (good.replace(b"\xc3\xa9", b"\xc3\xa8", 1), good[:-9], good + b"x",
                good.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(w.BadRecord):
            list(w.read_archive(_archive(bad)))
    cut = _archive(good).getvalue()[:-50]
    with pytest.raises(w.BadRecord):
        list(w.read_archive(io.BytesIO(cut)))


def test_pages_round_trip(spark):
    rows = [(i, f"http://h/{i}", "same" if i % 3 == 0 else f"page {i % 50}") for i in range(400)]
    rows += [(400, None, None), (401, "u", ""), (None, "u", "same"), (None, None, None), (402, "u", "x" * 3_000_000),
             (0, "http://h/0", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    df = df.withColumn("first", F.lit(1)).withColumn("digest", F.lit("d")).withColumn("n", F.lit(1))
    got = w.read_warc(w.write_warc(df, shared_path(spark, "warc-test"))).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        later = i is not None and first[h or ""] < i
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
                     "revisit" if later else "response", first[h or ""] if later else None))
    key = repr
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")],
                               "page_id long, url string, html string")
    got = w.read_warc(w.write_warc(df, shared_path(spark, "warc-test"), min_bytes=3)).collect()
    assert {r["page_id"]: r["refers_to"] for r in got} == {1: None, 2: None, 3: None, 4: 3}


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert w.read_warc(w.write_warc(df, shared_path(spark, "warc-test"))).count() == 0


def test_long_url_and_many_archives(spark):
    """A url longer than any buffer, and archives that are closed after every few records."""
    rows = [(i, "http://h/" + "a/" * 150_000 if i < 3 else f"u{i}", f"p{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    manifest = w.write_warc(df, shared_path(spark, "warc-test"), archive_bytes=2000)
    assert manifest.count() > 5 and manifest.agg(F.sum("records")).first()[0] == 60
    got = {r["page_id"]: (r["url"], r["payload_bytes"]) for r in w.read_warc(manifest).collect()}
    assert got == {i: (u, len(p)) for i, u, p in rows}
