"""Window query, index order, topic grouping and the digest text."""

from pyspark.sql import functions as F

from tidepool.operators import digest as D
from tidepool.operators import index as I
from tidepool.operators import query as Q
from tidepool.operators import verify as V

SCHEMA = ("path string, title string, source string, url string, published string, "
          "primary_topics array<string>, secondary_topics array<string>, summary string")


def index(spark):
    rows = [
        ("a/one.md", "One", "s1", "https://x/1", "2024-01-10", ["ai", "policy"], [], "first " * 30),
        ("a/two.md", "Two [x]", "s2", "https://x/2", "2024-01-12", ["ai"], ["eu"], "second"),
        ("a-b.md", "", "s1", "", "2024-01-12", [], [], ""),
        ("a/b.md", "Four", "s1", "javascript:alert(1)", "", ["ai", "ai"], [], "four"),
        ("z.md", "Five", "s3", "https://x/5", "2024-01-11T09:00", ["policy"], [], None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_window_filters_and_order(spark):
    idx = index(spark)
    w = Q.window_query(idx, since="2024-01-11").select("path", "rank").collect()
    assert [r["path"] for r in w] == ["a/two.md", "a-b.md", "z.md"]  # ties by path parts: a/two < a-b
    assert [r["rank"] for r in w] == [1, 2, 3]
    assert [r.path for r in Q.window_query(idx, until="2024-01-10").collect()] == ["a/one.md", "a/b.md"]
    assert {r.path for r in Q.window_query(idx, topic="eu").collect()} == {"a/two.md"}
    assert Q.window_query(idx, source="nope").count() == 0
    assert Q.window_query(idx, limit=2).count() == 2


def test_index_order_global_rank(spark):
    ranked = I.index_order(index(spark)).orderBy("rank").select("path").collect()
    assert [r.path for r in ranked] == ["a/two.md", "a-b.md", "z.md", "a/one.md", "a/b.md"]


def test_group_by_topic_counts_repeats(spark):
    g = {r["topic"]: r["n_entries"] for r in D.group_by_topic(index(spark)).collect()}
    assert g == {"ai": 4, "policy": 2, "(uncategorized)": 1}


def test_digest_text(spark):
    lines = D.digest(index(spark), since="2024-01-10", limit=50)
    text = D.digest_text(lines).first()["digest"]
    head, gen = text.splitlines()[:2]
    assert head == "# Digest · since 2024-01-10"
    assert gen == "_Generated 2024-02-01 · 4 entries_"
    sections = [ln for ln in text.splitlines() if ln.startswith("## ")]
    assert sections == ["## ai", "## policy", "## (uncategorized)"]
    assert "- [Two \\[x\\]](<https://x/2>) — s2 · 2024-01-12\n  _second_" in text
    assert "- (untitled) — s1 · 2024-01-12" in text
    assert text.endswith("\n") and not text.endswith("\n\n")
    assert "…" in text  # long summary snippet


def test_digest_refuses_unsafe_scheme(spark):
    idx = index(spark)
    text = D.digest_text(D.digest(idx, limit=50)).first()["digest"]
    assert "javascript:" not in text and "- Four — s1" in text


def test_verification_join(spark):
    entries = index(spark)
    tiers = spark.createDataFrame([("https://x/1", "live"), ("https://x/2", "dead")], "url string, tier string")
    got = {r.path: r.tier for r in V.verification_join(entries, tiers).collect()}
    assert got["a/one.md"] == "live" and got["a/two.md"] == "dead"
    assert got["z.md"] == "stale" and got["a-b.md"] is None


def test_stored_index_prunes_months(spark, tmp_path):
    idx = I.index_entry(index(spark).withColumn("enriched", F.lit(True)))
    path = I.sink_index(idx, str(tmp_path / "index"))
    stored = I.scan_index(spark, path)
    w = Q.window_query(stored, since="2024-01-11")
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan
    assert [r.path for r in w.collect()] == ["a/two.md", "a-b.md", "z.md"]


def test_digest_neutralises_injection(spark):
    rows = [("p.md", "x](javascript:alert(1)) [", "s", "https://ok.example/a b", "2024-01-02", ["ai"], [],
             "see <https://evil.example> and [click](javascript:x) `code`")]
    text = D.digest_text(D.digest(spark.createDataFrame(rows, SCHEMA), limit=5)).first()["digest"]
    bullet = [ln for ln in text.splitlines() if ln.startswith("- ")][0]
    assert bullet.startswith("- [x\\](javascript:alert(1)) \\[](<https://ok.example/a%20b>)")
    snippet = [ln for ln in text.splitlines() if ln.startswith("  _")][0]
    assert "\\<https://evil.example\\>" in snippet and "\\[click\\]" in snippet and "\\`code\\`" in snippet


def test_index_json_lines_round_trip(spark, tmp_path):
    idx = I.index_entry(index(spark).withColumn("enriched", F.lit(True)))
    path = I.export_index_json(idx.withColumn("month", F.lit("x")), str(tmp_path / "json"))
    back = spark.read.json(path)
    assert back.count() == 5 and "month" not in back.columns
