"""WARC archives: exact round trips through the index."""

import base64
import hashlib
import random

from pyspark.sql import functions as F

from tidepool.llm import warc
from tidepool.llm.common import scratch_path

BIG = 2**60 + 1
PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (BIG, "http://a/é ?x=1\r\n%41", "same"), (4, None, None), (5, "", ""),
         (6, "http://a/6", "é😀\r\n\r\nWARC/1.1\r\n" * 3), (7, "http://a/7", "x" * 300_000), (None, "http://n", "same"), (None, "http://m", "alone"),
         (8, "http://a/8", "twice"), (8, "http://a/8", "twice"), (9, "q", "y" * 9)]
SCHEMA = "page_id long, url string, html string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(pages, least=0):
    largest = {}
    for page, _, html in pages:
        if page is not None:
            largest[html or ""] = max(largest.get(html or "", page), page)
    out = []
    for page, _, html in pages:
        size = len((html or "").encode())
        keeper = largest.get(html or "")
        revisit = size >= least and keeper is not None and page != keeper
        out.append((page, size, sha(html), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_round_trip_with_copies_nulls_and_repeated_rows(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    assert got(warc.archive_round_trip(pages)) == expected(PAGES)
    assert got(warc.archive_round_trip(pages, least_bytes=5)) == expected(PAGES, 5)


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_selected_records_come_back_whole(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 2_000)
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"page {k} " * (k * 7 % 50)) for k in range(300)], SCHEMA).withColumn("archive", F.lit(1)).repartition(3)
    index = warc.write_archives(pages, scratch_path(spark, "warc-test"))
    assert index.count() == 300 and index.select("archive").distinct().count() <= 3
    for r in index.groupBy("archive").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect():
        assert r.n == r.end  # records lie end to end
    some = warc.read_records(index.where("page_id % 7 = 3"), with_payload=True).collect()
    assert all(bytes(r.payload).decode() == f"page {r.page_id} " * (r.page_id * 7 % 50) for r in some if r.record_type == "response")
    assert {r.page_id for r in some} == {k for k in range(300) if k % 7 == 3}
    assert {r.url for r in some} == {f"http://a/{k}" for k in range(300) if k % 7 == 3}


def test_reading_is_dealt_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_SPLIT", 1_000)
    monkeypatch.setattr(warc, "SPLIT_BYTES", 20_000)
    rng = random.Random(3)
    pages = spark.createDataFrame([(k, None, rng.randbytes(1 if k < 1_500 else 500).hex()) for k in range(2_000)], SCHEMA).repartition(2)
    index = warc.write_archives(pages, scratch_path(spark, "warc-test"))
    sizes = [r.n for r in warc._dealt(index).groupBy(F.spark_partition_id()).agg(F.sum("length").alias("n")).collect()]
    longest, total = index.agg(F.max("length")).first()[0], index.agg(F.sum("length")).first()[0]
    assert sum(sizes) == total and len(sizes) >= total / 20_000 and max(sizes) <= 20_000 + longest
    assert warc.read_records(index).count() == 2_000
    assert warc.read_records(index.limit(0)).collect() == []


def test_record_format():
    raw = warc.record_bytes("3", "http://x/ y", b"ab", 2, "D", None, False)
    fields, payload = warc.parse_record(raw)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\nab\r\n\r\n")
    assert payload == b"ab" and fields["warc-target-uri"] == "http://x/%20y" and fields["content-length"] == "2"
    assert warc.parse_record(warc.record_bytes("3", None, b"ab", 2, "D", "9", True))[1] == b""
