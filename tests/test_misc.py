"""Remaining edge cases: title collisions, body cap, prompts and packets, scans of documents."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidepool import contracts as C
from tidepool.operators import enrich as EN
from tidepool.operators import ingest as G
from tidepool.sources.scans import cap_bodies, parse_documents, meta_bool_true, meta_str


def test_long_titles_sharing_a_prefix_get_distinct_stems(spark):
    base = "A very long headline about the same topic " * 3
    items = spark.createDataFrame([(base + "part one", "https://x/1"), (base + "part two", "https://x/2")],
                                  "title string, link string")
    stems = [r.stem for r in G.dedup_key(items.withColumn("entry_id", F.lit("")).withColumn("description", F.lit("")))
             .collect()]
    assert len(set(stems)) == 2
    assert all(len(s.rsplit("-", 1)[0]) <= C.TITLE_MAX_LEN for s in stems)
    assert stems[0].endswith(hashlib.sha1(b"https://x/1").hexdigest()[:6])


def test_body_cap_rejects_whole_and_errors_are_empty(spark):
    df = spark.createDataFrame([(b"x" * 11, 200), (b"x" * 10, 200), (b"x" * 50, 404)], "body binary, status int")
    got = [(r.rejected, None if r.body is None else len(r.body)) for r in cap_bodies(df, max_bytes=10).collect()]
    assert got == [(True, None), (False, 10), (False, 0)]


def test_prompt_truncates_article(spark):
    df = spark.createDataFrame([("p.md", "T", "x" * 60000)], "path string, title string, content string")
    pk = EN.build_packets(df, {"b", "a"}, max_chars=50000).first()
    assert pk.article_chars == 60000
    assert pk.prompt.count("x") == 50000
    assert "Primary topic vocabulary: a, b" in pk.prompt
    assert pk.output_contract == C.OUTPUT_CONTRACT
    assert pk.prompt_chars == len(pk.prompt)
    assert pk.prompt_sha256 == hashlib.sha256(pk.prompt.encode()).hexdigest()


def test_prompt_without_vocabulary(spark):
    assert "(empty)" in EN.system_text(set())


def test_frontmatter_parsing_and_enriched_flag(spark):
    docs = spark.createDataFrame([
        ("a", "---\ntitle: A\nenriched: true\npublished: 2024-01-05\ntags: [x, y]\n---\n\nbody a\n"),
        ("b", "---\ntitle: B\nenriched: \"true\"\n---\nbody b"),
        ("c", "no frontmatter at all"),
        ("d", "---\ntitle: [unclosed\n---\nbody"),
    ], "path string, text string")
    p = {r.path: r for r in parse_documents(docs).select(
        "path", "readable", "body", meta_str("title").alias("title"), meta_str("published").alias("published"),
        meta_bool_true("enriched").alias("enriched")).collect()}
    assert p["a"].title == "A" and p["a"].enriched is True and p["a"].published == "2024-01-05"
    assert p["a"].body == "\nbody a\n"
    assert p["b"].enriched is False            # the string "true" is not enriched
    assert p["c"].readable and p["c"].title is None and p["c"].body == "no frontmatter at all"
    assert p["d"].readable is False            # malformed YAML → quarantined


def test_binary_file_scan_with_cap(spark, tmp_path):
    from tidepool.sources.scans import scan_bodies_capped
    for name, size in (("a.html", 5), ("b.html", 10), ("c.html", 20), ("d.txt", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    ok, over = scan_bodies_capped(spark, str(tmp_path), glob="*.html", max_bytes=10)
    assert sorted(r.length for r in ok.select("length").collect()) == [5, 10]
    assert [r.length for r in over.collect()] == [20]
    plan = ok._jdf.queryExecution().executedPlan().toString()
    assert "length" in plan and "<= 10" in plan


def test_feed_files(spark, tmp_path):
    from tidepool.sources.scans import scan_feed_files
    (tmp_path / "a.xml").write_text('<rss version="2.0"><channel><item><title>One</title><link>https://x/1</link>'
                                    '<pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>')
    (tmp_path / "b.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Two</title>'
                                    '<link href="https://x/2"/><published>2024-01-03T00:00:00Z</published>'
                                    '</entry></feed>')
    (tmp_path / "c.txt").write_text("not a feed")
    got = sorted((r.title, r.link, r.date, r.feed_path.rsplit("/", 1)[-1]) for r in scan_feed_files(spark, str(tmp_path)).collect())
    assert got == [("One", "https://x/1", "2024-01-02", "a.xml"), ("Two", "https://x/2", "2024-01-03", "b.xml")]


def test_file_tree_commits_together_on_any_store(spark, tmp_path):
    """A URI as root; a failing task leaves no file and no staging folder; names cannot leave the tree."""
    from tidepool.sources.filetree import write_files

    root = tmp_path / "tree"
    rows = spark.range(20).selectExpr("concat('ns', id % 3, '/sub') AS dir", "concat(id, ' é + %20.md') AS name", "concat('text ', id) AS body").repartition(4)
    write_files(rows, root.as_uri())
    files = {str(f.relative_to(root)): f.read_text() for f in root.rglob("*") if f.is_file()}
    assert files == {f"ns{i % 3}/sub/{i} é + %20.md": f"text {i}" for i in range(20)}
    failing = rows.withColumn("body", F.when(F.col("name").startswith("7 "), F.raise_error(F.lit("stop"))).otherwise("new"))
    for bad in (failing, rows.withColumn("name", F.lit("../../out.md"))):
        with pytest.raises(Exception):
            write_files(bad, str(root))
        assert {str(f.relative_to(root)): f.read_text() for f in root.rglob("*") if f.is_file()} == files
        assert not list(root.glob(".staging-*"))
    write_files(rows.where("dir = 'ns0/sub'").withColumn("body", F.lit("replaced")), str(root))
    assert (root / "ns0/sub/0 é + %20.md").read_text() == "replaced" and len(list(root.rglob("*.md"))) == 20


def test_truncated_pages_keep_whole_characters(spark):
    from tidepool.sources.scans import truncate_bodies
    df = spark.createDataFrame([("é" * 10,), ("abc",), (None,), ("x" * 11,)], "body string")
    assert [(r.body, r.truncated) for r in truncate_bodies(df, max_bytes=10).collect()] == [("é" * 10, True), ("abc", False), (None, False), ("x" * 10, True)]


def test_python_gets_rows_by_bytes(spark):
    """Batches of long texts hold fewer rows, for Arrow functions and mapInPandas alike."""
    import pandas as pd
    from pyspark.sql import functions as F

    from tidepool.session import prepare
    prepare(spark)
    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))  # 40 MB

    @F.pandas_udf("long")
    def rows(s: pd.Series) -> pd.Series:
        return pd.Series([len(s)] * len(s))
    most = texts.select(rows("t").alias("n")).agg(F.max("n")).first()[0]
    mapped = texts.mapInPandas(lambda bs: (pd.DataFrame({"n": [len(b)]}) for b in bs), "n long").agg(F.max("n")).first()[0]
    assert most <= 50 and mapped <= 50
