"""The user-facing jobs end to end on small stored tables."""

from pyspark.sql import functions as F

from tidepool.plans import jobs as J
from tidepool.plans.fixtures import registry_from_sources

RSS = ('<rss version="2.0"><channel><title>F</title>'
       '<item><title>Agents at work</title><link>https://a.example/1</link>'
       '<pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate><description>about agents</description></item>'
       '<item><title>Other news</title><link>https://a.example/2</link>'
       '<pubDate>Wed, 03 Jan 2024 10:00:00 +0000</pubDate><description>the rest</description></item>'
       '</channel></rss>')


def test_ingest_index_window_digest(spark, tmp_path):
    feeds = spark.createDataFrame([("src0", RSS)], "source string, xml string")
    reg = registry_from_sources(spark.createDataFrame([("src0",)], "source string"))
    seen = spark.createDataFrame([], "namespace string, file_name string")
    fetched = spark.createDataFrame([("https://a.example/1", "word " * 150)], "url string, body string")
    new = J.ingest(spark, reg, seen, fetched, str(tmp_path / "docs"), feeds=feeds)
    rows = {r.url: r for r in new.collect()}
    assert set(rows) == {"https://a.example/1", "https://a.example/2"}   # src0: no keyword filter, full content on
    assert rows["https://a.example/1"].file_name.startswith("2024-01-02 - Agents at work-")
    assert "word word" in rows["https://a.example/1"].doc_text           # fetched body replaced the excerpt
    # second run: nothing new once the files exist
    seen2 = spark.read.parquet(str(tmp_path / "docs")).select("namespace", "file_name")
    again = J.ingest(spark, reg, seen2, fetched, str(tmp_path / "docs2"), feeds=feeds)
    assert again.count() == 0

    docs = new.select(F.concat("namespace", F.lit("/"), "file_name").alias("path"), F.lit("T").alias("title"),
                      "source", "url", F.col("date").alias("published"), F.lit(True).alias("enriched"),
                      F.array(F.lit("ai")).alias("primary_topics"), F.lit("summary text").alias("summary"))
    idx = J.build_index(spark, docs, str(tmp_path / "index"))
    w = J.window(spark, idx, since="30d", run_date="2024-01-31")
    assert [r.published for r in w.collect()] == ["2024-01-03", "2024-01-02"]
    lines = [r.line for r in J.digest(spark, idx, since="2024-01-01").orderBy("line_no").collect()]
    assert lines[0] == "# Digest · since 2024-01-01" and "## ai" in lines


def test_markdown_documents_to_index(spark, tmp_path):
    from tidepool.operators import index as I
    from tidepool.sources.scans import scan_documents
    root = tmp_path / "content"
    (root / "feed-a").mkdir(parents=True)
    (root / "feed-a" / "2024-01-05 - First-abc123.md").write_text(
        "---\ntitle: First\nsource: feed-a\nurl: https://a/1\npublished: 2024-01-05\ntags: news\n"
        "enriched: true\nsummary: S1\ntopics:\n  primary:\n    - ai\n  secondary: []\n"
        "entities:\n  organizations: [Acme]\n  people: []\n---\n\nBody one\n")
    (root / "feed-a" / "Untitled-stem.md").write_text(
        "---\nsource: feed-a\nenriched: true\ntopics: not-a-mapping\n---\nBody two\n")
    (root / "feed-a" / "pending.md").write_text("---\ntitle: Pending\nenriched: \"true\"\n---\nx\n")
    (root / "feed-a" / "broken.md").write_text("---\ntitle: [unclosed\n---\nx\n")
    docs, bad = scan_documents(spark, str(root))
    assert [r.path for r in bad.collect()] == ["feed-a/broken.md"]
    typed = I.documents_from_markdown(docs)
    entries = {r.path: r for r in I.index_order(I.index_from_documents(typed)).collect()}
    assert set(entries) == {"feed-a/2024-01-05 - First-abc123.md", "feed-a/Untitled-stem.md"}
    first = entries["feed-a/2024-01-05 - First-abc123.md"]
    assert (first.title, first.published, first.tags, first.primary_topics, first.rank) == \
        ("First", "2024-01-05", ["news"], ["ai"], 1)
    second = entries["feed-a/Untitled-stem.md"]
    assert (second.title, second.published, second.primary_topics, second.rank) == ("Untitled-stem", "", [], 2)


def test_many_small_markdown_files_take_few_tasks(spark, tmp_path):
    """Small files share tasks (Spark alone puts 32 into one), none is lost, and each frontmatter is parsed once."""
    from tidepool.operators import index as I
    from tidepool.sources.scans import scan_documents
    n = 1000
    for i in range(n):
        folder = tmp_path / f"s{i % 3}"
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.md").write_bytes(b"\xef\xbb\xbfplain\r\n" if i == 0 else f"---\ntitle: é{i}\nenriched: true\n---\nbody {i}\n".encode())
    docs, bad = scan_documents(spark, str(tmp_path))
    entries = I.index_from_documents(I.documents_from_markdown(docs))
    assert entries.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert entries._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert {(r.path, r.title) for r in entries.collect()} == {(f"s{i % 3}/{i}.md", f"é{i}") for i in range(1, n)}
    assert docs.where("meta IS NULL").select("path", "body").collect() == [("s0/0.md", "\ufeffplain\r\n")] and bad.count() == 0


def test_whole_pass(spark, tmp_path):
    """ingest → packets → enrich → writeback → index → window/digest."""
    from tidepool.operators import enrich as EN
    from tidepool.operators import index as I
    from tidepool.operators import ingest as G
    from tidepool.operators import records as R
    from tidepool.sources import scans as SC
    feeds = spark.createDataFrame([("src0", RSS)], "source string, xml string")
    reg = registry_from_sources(spark.createDataFrame([("src0",)], "source string"))
    seen = spark.createDataFrame([], "namespace string, file_name string")
    fetched = spark.createDataFrame([], "url string, body string")
    new = G.ingest_feed_items(SC.scan_feed_raw(feeds), reg, seen, fetched)
    docs = I.documents_from_ingest(new)
    backlog = I.filter_backlog(docs).withColumn("content", F.col("body"))
    packets = EN.build_packets(backlog, {"markets", "science"})
    assert packets.count() == 2
    answers = EN.enrich_with(backlog, EN.lead_text_enricher({"markets", "science"}), "stand-in") \
        .withColumn("attempt", F.lit(1))
    res = R.writeback(answers, {"markets", "science"}, [])
    assert R.batch_report(res).first().asDict() == {"succeeded": 2, "failed": 0}
    merged = R.upsert_metadata(docs, res)
    idx = I.index_from_documents(merged)
    assert idx.count() == 2 and {tuple(r.primary_topics) for r in idx.collect()} == {("markets",)}
    path = I.sink_index(idx, str(tmp_path / "index"))
    top = J.window(spark, path, since="2024-01-01", run_date="2024-02-01")
    assert [r.published for r in top.collect()] == ["2024-01-03", "2024-01-02"]
    # the same answers written back into a document table
    from tidepool.sources import doctable as DT
    DT.store_documents(docs, "whole_pass_documents", str(tmp_path / "table"))
    report = J.writeback_documents(spark, "whole_pass_documents", answers, {"markets", "science"}, [], str(tmp_path / "failed"))
    assert report.first().asDict() == {"succeeded": 2, "failed": 0}
    stored = {r.path: (r.body, r.summary) for r in spark.table("whole_pass_documents").collect()}
    assert stored == {r.path: (r.body, r.summary) for r in merged.collect()} and all(s for _, s in stored.values())
    spark.sql("DROP TABLE whole_pass_documents")


def test_markdown_backlog_requeues_unreadable(spark, tmp_path):
    root = tmp_path / "c"
    root.mkdir()
    (root / "done.md").write_text("---\nenriched: true\n---\nx")
    (root / "todo.md").write_text("---\ntitle: T\n---\nx")
    (root / "bad.md").write_text("---\ntitle: [x\n---\nx")
    got = {(r.path, r.readable) for r in J.markdown_backlog(spark, str(root)).collect()}
    assert got == {("todo.md", True), ("bad.md", False)}


def test_build_index_from_typed_documents(spark, tmp_path):
    from tidepool.operators import index as I
    docs = spark.createDataFrame(
        [("a.md", "A", "s", "u", "2024-01-01", True, (["x"], ["y"]))],
        "path string, title string, source string, url string, published string, enriched boolean, "
        "topics struct<primary: array<string>, secondary: array<string>>")
    path = J.build_index(spark, docs, str(tmp_path / "idx"), generated="2024-02-01T00:00:00Z")
    r = I.scan_index(spark, path).first()
    assert r.primary_topics == ["x"] and r.secondary_topics == ["y"] and r.generated == "2024-02-01T00:00:00Z"
