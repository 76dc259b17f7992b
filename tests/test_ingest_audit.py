"""Ingest order rules, dedup, feeds, transcripts, throttle audit and leak scan."""

import pytest
from pyspark.sql import functions as F

from tidepool.functions.dates import parse_pub_date, yyyymmdd_to_iso
from tidepool.operators import audit as A
from tidepool.operators import ingest as G
from tidepool.operators.transcripts import best_track, transcript_concat
from tidepool.sources.scans import scan_captions, scan_feed

REG = ("name string, source_ord int, type string, feed_url string, output_dir string, tags array<string>, "
       "perspective string, scrape_limit int, scrape_full_content boolean, throttle_group string, "
       "throttle_seconds double, kf_mode string, kf_include array<string>, listing_link_pattern string, "
       "enabled boolean")


def registry(spark, limit=2, include=("agents",), enabled=True):
    return spark.createDataFrame([("s1", 1, "rss", "https://s1/feed", "ns", ["t"], None, limit, False, None, 0.0,
                                   "any", list(include), None, enabled)], REG)


def entries(spark, titles):
    rows = [("s1", i, t, f"https://s1/{i}", "", "desc", "body", "2024-01-0%d" % (i + 1)) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "source string, pos long, title string, link string, entry_id string, "
                                       "description string, content string, date string")


def test_limit_applies_before_keyword_filter(spark):
    e = entries(spark, ["boring", "also boring", "AI agents news"])
    j = G.join_registry(e, registry(spark, limit=2))
    out = G.keyword_filter(G.limit_per_source(j, max_limit=2), G.feed_filter_text())
    assert out.count() == 0  # the matching item was the third, beyond the limit


def test_disabled_source_drops_out(spark):
    e = entries(spark, ["agents"])
    assert G.join_registry(e, registry(spark, enabled=False)).count() == 0


def test_dedup_first_wins_and_seen_any_date(spark):
    items = spark.createDataFrame([
        ("ns", 2, 5, "Same Title", "https://x/a", "", "d"),
        ("ns", 1, 9, "Same Title", "https://x/a", "", "d"),
        ("ns", 1, 3, "Other", "", "", "d"),          # link-less: title + description identify it
        ("ns", 1, 4, "Other", "", "", "e"),
    ], "namespace string, source_ord int, pos long, title string, link string, entry_id string, description string")
    firsts = G.first_wins_dedup(G.dedup_key(items))
    got = {(r.stem, r.pos) for r in firsts.collect()}
    assert len(got) == 3 and any(p == 9 for _, p in got)
    stem = [s for s, p in got if p == 9][0]
    seen = spark.createDataFrame([("ns", f"2020-01-01 - {stem}.md")], "namespace string, file_name string")
    assert G.anti_join_seen(firsts, seen).count() == 2


def test_full_body_join_needs_100_words(spark):
    items = spark.createDataFrame([("https://a", True, "excerpt"), ("https://b", True, "excerpt"),
                                   ("", True, "excerpt")], "link string, scrape_full_content boolean, content string")
    fetched = spark.createDataFrame([("https://a", "w " * 100), ("https://b", "w " * 99), ("", "w " * 200)],
                                    "url string, body string")
    got = {r.link: r.content_from for r in G.full_body_join(items, fetched).collect()}
    assert got == {"https://a": "fetched", "https://b": "excerpt", "": "excerpt"}


def test_scan_feed_both_dialects(spark):
    rss = ('<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>T</title>'
           '<item><title>A &amp; <![CDATA[<b>B</b>]]></title><link>https://x/a</link>'
           '<pubDate>Mon, 01 Jan 2024 23:30:00 -0500</pubDate><description>&lt;p&gt;hi&lt;/p&gt;</description>'
           '<guid>g1</guid></item>'
           '<item><title>Empty content</title><description>d</description>'
           '<content:encoded></content:encoded></item></channel></rss>')
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>C</title>'
            '<link rel="self" href="https://x/self"/><link rel="alternate" href="https://x/c"/>'
            '<id>urn:c</id><updated>2024-01-03T10:00:00Z</updated><summary>s</summary></entry></feed>')
    df = spark.createDataFrame([(1, rss), (2, atom)], "doc_id long, xml string")
    got = scan_feed(df).orderBy("doc_id", "pos").collect()
    assert [(r.title, r.link, r.date, r.entry_id) for r in got] == [
        ("A & B", "https://x/a", "2024-01-02", "g1"),
        ("Empty content", "", "2024-02-01", ""),
        ("C", "https://x/c", "2024-01-03", "urn:c")]
    assert got[0].description == "hi" and got[1].content == ""  # present-but-empty content does not fall back


def test_parse_pub_date_forms(spark):
    vals = ["Tue, 02 Jan 2024", "2 Jan 2024 10:00:00 GMT", "2024-01-05", "2024-01-05T23:00:00-03:00", "garbage", ""]
    df = spark.createDataFrame([(v,) for v in vals], "p string")
    got = [r[0] for r in df.select(parse_pub_date(F.col("p"))).collect()]
    assert got == ["2024-01-02", "2024-01-02", "2024-01-05", "2024-01-06", "2024-02-01", "2024-02-01"]


def test_captions(spark):
    lines = spark.createDataFrame([(1, '{"id":"a","upload_date":"20240105"}'), (2, "{bad"), (3, ""),
                                   (4, '{"title":"no id"}'), (5, '{"id":"b","title":"B","upload_date":"2024"}')],
                                  "n long, line string")
    got = [(r.id, r.title, r.upload_date) for r in scan_captions(lines).orderBy("n").collect()]
    assert got == [("a", "a", "2024-01-05"), ("b", "B", "2024")]
    df = spark.createDataFrame([("",), (None,)], "d string")
    assert [r[0] for r in df.select(yyyymmdd_to_iso(F.col("d"))).collect()] == ["2024-02-01", "2024-02-01"]


def test_transcripts(spark):
    segs = spark.createDataFrame([
        (1, 0, " hello ", "generated_en"), (1, 1, "world", "generated_en"), (1, 0, "manual", "manual_en"),
        (2, 3, "b", "other"), (2, 1, "a", "other2"), (2, 2, "  ", "other2"),
    ], "video long, seq long, segment string, track string")
    best = {r.video: r.track for r in best_track(segs).collect()}
    assert best == {1: "manual_en", 2: "other2"}
    t = {r.video: r.transcript for r in transcript_concat(segs.where(F.col("track") == "generated_en"), chunk=1).collect()}
    assert t == {1: "hello world"}


def test_throttle_wait_across_ranges(spark):
    s = 1_000_000
    log = spark.createDataFrame([
        (1, "g", 0, 65 * s, 10 * s),         # 65 s fetch
        (2, "g", 70 * s, 71 * s, 10 * s),     # 5 s after completion → wait 5 s
        (3, "g", 100 * s, 101 * s, 10 * s),   # 29 s after → no wait
        (4, None, 0, 1, 10 * s),
        (5, "h", 0, 1, 0),
    ], "event_id long, throttle_group string, ts_us long, end_us long, throttle_us long")
    for ranges in (1, 2, 7):
        got = {r.event_id: r.wait_us for r in A.throttle_wait(log, ranges=ranges).collect()}
        assert got == {1: 0, 2: 5 * s, 3: 0, 4: 0, 5: 0}


def test_throttle_wait_spreads_one_group_on_one_day(spark):
    """A single group, many fetches of the same instants: all ranges have rows, and the waits are those of one lag."""
    s, n = 1_000_000, 4_000
    log = spark.range(n).selectExpr("id AS event_id", "'g' AS throttle_group", f"(id DIV 3) * {s} AS ts_us",
                                    f"(id DIV 3) * {s} + (id % 5) * {s // 4} AS end_us", f"{s}L AS throttle_us")
    got = A.throttle_wait(log, ranges=8)
    ends = [(i // 3) * s + (i % 5) * (s // 4) for i in range(n)]
    want = {i: max(0, s - ((i // 3) * s - ends[i - 1])) if i else 0 for i in range(n)}
    assert {r.event_id: r.wait_us for r in got.collect()} == want
    sizes = [r["count"] for r in log.repartitionByRange(8, "throttle_group", "ts_us", "event_id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < n / 4


def test_dry_run_counts_a_missing_limit_as_the_default(spark):
    registry = spark.createDataFrame([("f", "rss", None, True), ("g", "rss", 3, True), ("v", "youtube", None, True), ("off", "rss", None, False)],
                                     "name string, type string, scrape_limit int, enabled boolean")
    entries = spark.createDataFrame([("f",)] * 30 + [("g",)] * 2, "source string")
    got = {r.source: r.would_scrape for r in A.dry_run_preview(entries, registry).collect()}
    assert got == {"f": 10, "g": 2, "v": 10, "TOTAL": 22}


def test_leak_scan(spark):
    docs = spark.createDataFrame([(1, "clean line\nmail me at bob@mail.example.com\nnoreply@x.example.com"),
                                  (2, 'token = "0123456789abcdef0123"\nat 10.0.0.1 now')], "doc_id long, text string")
    got = sorted((r.doc_id, r.line_no, r.label) for r in A.leak_scan(docs).collect())
    assert got == [(1, 2, "email"), (2, 1, "secret_token"), (2, 2, "ipv4_address")]


def test_run_health(spark):
    checks = spark.createDataFrame([("r1", "a", None), ("r1", "b", None), ("r2", "a", 404), ("r2", "b", None),
                                    ("r3", "a", 200)], "run string, source string, status int")
    got = {r.run: r.exit_code for r in A.run_health(checks).collect()}
    assert got == {"r1": 1, "r2": 1, "r3": 0}


def test_parse_pub_date_zone_names_match_python(spark):
    import datetime as dt
    from email.utils import parsedate_to_datetime
    vals = ["Tue, 02 Jan 2024 22:00:00 EST", "Tue, 02 Jan 2024 22:00:00 PST", "2 Jan 2024 22:00 +0100",
            "Tue, 02 Jan 2024 22:00:00 UT", "Wed, 31 Jan 2024 23:59:59 -0000"]
    df = spark.createDataFrame([(v,) for v in vals], "p string")
    got = [r[0] for r in df.select(parse_pub_date(F.col("p"))).collect()]
    want = [parsedate_to_datetime(v).astimezone(dt.timezone.utc).strftime("%Y-%m-%d") for v in vals]
    assert got == want


@pytest.mark.parametrize("raw,day", [
    ("May 20th, 2026", "2026-05-20"), ("20 May 2026 at 3pm EST", "2026-05-20"), ("Friday the", None), ("Tuesday, 3rd of September 2024 11:30 pm EDT", "2024-09-04"),
    ("2024 March 5", "2024-03-05"), ("05/06/2024", "2024-05-06"), ("25/06/2024", "2024-06-25"), ("25.06.24", "2024-06-25"), ("2024/07/08 01:00 +0200", "2024-07-07"),
    ("20240229", "2024-02-29"), ("20230229", None), ("May 2024", "2024-05-01"), ("March 5", "2024-03-05"), ("3 days ago", None), ("soon", None), ("12 Foober 2024", None),
    ("Dec 31 1999 12 a.m.", "1999-12-31"), ("31 Dec, 99 12:30 p.m. PST", "1999-12-31"), ("Sept. 9, 2024 (updated)", "2024-09-09"), ("1/2/3/4", None), ("", None), (None, None)])
def test_free_form_dates_and_what_fits_none(spark, raw, day):
    from tidepool.functions.dates import pub_date
    df = spark.createDataFrame([(raw,)], "p string")
    assert df.select(pub_date(F.col("p"), "2024-02-01").alias("d")).first().d == day
    assert df.select(parse_pub_date(F.col("p"), "2024-02-01").alias("d")).first().d == (day or "2024-02-01")
