"""Inputs that used to vanish or change silently: odd feeds, limits, nulls, paths, dates, versions."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidepool.functions import text as TX
from tidepool.functions.dates import parse_pub_date
from tidepool.operators import index as I
from tidepool.operators import ingest as G
from tidepool.operators import query as Q
from tidepool.operators import records as R
from tidepool.operators import verify as V
from tidepool.sources import scans as SC

ITEM = "<item><title>T{0}</title><link>https://a/{0}</link><description>d &amp; e</description></item>"


def rss(n=1, head=""):
    return f'<rss version="2.0"><channel><title>F{head}</title>' + "".join(ITEM.format(k) for k in range(n)) + "</channel></rss>"


def test_feeds_with_anything_before_their_root_are_read(spark):
    feeds = [
        ("plain", rss()), ("stylesheet", '<?xml version="1.0"?>\n<?xml-stylesheet href="a.xsl"?>' + rss()), ("bom", "\ufeff" + rss()),
        ("comment", "<!-- " + "c" * 5000 + " -->" + rss()), ("doctype", '<!DOCTYPE rss [ <!ENTITY x "y"> ]>' + rss()),
        ("entity", rss(head="&nbsp;&eacute;")), ("several", rss(3)), ("html", "<html></html>"), ("cut", rss()[:-30]), ("empty", rss(0)), ("null", None)]
    df = spark.createDataFrame(feeds, "name string, xml string")
    got = {}
    for r in SC.scan_feed(df).collect():
        got.setdefault(r.name, []).append((r.pos, r.title, r.link, r.description))
    one = [(0, "T0", "https://a/0", "d & e")]
    assert all(got[n] == one for n in ("plain", "stylesheet", "bom", "comment", "doctype", "entity"))
    assert sorted(t for _, t, _, _ in got["several"]) == ["T0", "T1", "T2"]
    lost = {r.name: r.reason for r in SC.feed_quarantine(df).collect()}
    assert lost == {"html": "not_a_feed", "cut": "unreadable", "null": "not_a_feed"}


@pytest.mark.parametrize("limit,kept", [(50, 30), (None, 10), (3, 3)])
def test_limits_of_sources(spark, limit, kept):
    items = spark.range(30).selectExpr("'s' as source", "id as pos").withColumn("scrape_limit", F.lit(limit).cast("int"))
    assert G.limit_per_source(items).count() == kept
    reg = spark.createDataFrame([("s", True, "", limit)], "name string, enabled boolean, perspective string, scrape_limit int")
    stats = G.registry_stats(reg)
    joined = G.join_registry(items.drop("scrape_limit"), reg)
    assert G.limit_per_source(joined, max_limit=stats["max_limit"]).count() == kept


def test_sources_are_served_by_their_adapter_and_first_wins_across(spark):
    reg = spark.createDataFrame([("a", "rss"), ("b", "youtube"), ("c", None)], "name string, type string")
    assert [r.name for r in G.of_type(reg, "rss").collect()] == ["a"]
    made = lambda name, order: spark.createDataFrame([("ns", "same", order, name), ("ns", name, order, name)], "namespace string, stem string, source_ord int, by string")
    got = sorted((r.stem, r.by) for r in G.first_across_adapters(made("feed", 5), made("page", 2)).collect())
    assert got == [("feed", "feed"), ("page", "page"), ("same", "page")]


def test_json_nulls_are_nulls(spark):
    df = spark.createDataFrame([('{"url": null, "published": null, "tags": null}',)], "j string").select(F.parse_json("j").alias("meta"))
    r = df.select(SC.meta_str("url").alias("u"), SC.meta_str("published").alias("p"), SC.ensure_list(F.try_variant_get("meta", "$.tags", "variant")).alias("t")).first()
    assert (r.u, r.p, r.t) == (None, None, [])


def test_plus_in_paths(spark, tmp_path):
    (tmp_path / "C++ tips é.md").write_text("---\ntitle: x\n---\nb\n")
    docs, _ = SC.scan_documents(spark, str(tmp_path))
    assert [r.path for r in docs.collect()] == ["C++ tips é.md"]


def test_odd_dates_give_the_same_window_stored_or_not(spark, tmp_path):
    dates = ["May 20, 2026", "2024-05-01", "2024", "", None, "2024-13-40", "soon"]
    rows = [(f"p/{k}.md", d, True) for k, d in enumerate(dates)]
    entries = I.index_entry(spark.createDataFrame(rows, "path string, published string, enriched boolean"))
    stored = I.scan_index(spark, I.sink_index(entries, str(tmp_path / "index")))
    for bounds in ({"since": "2024-05-01"}, {"until": "2024-05-01"}, {"since": "2024", "until": "N"}, {}):
        assert {r.path for r in Q.window_query(entries, **bounds).collect()} == {r.path for r in Q.window_query(stored, **bounds).collect()}, bounds


def test_blocked_wins_and_the_latest_check_counts(spark):
    entries = spark.createDataFrame([("u1",), ("u2",), ("u3",), ("u4",)], "url string")
    checks = [("u1", "blocked", 1), ("u1", "live", 2), ("u2", "dead", 1), ("u2", "live", 2), ("u3", "live", 1), ("u3", "dead", 1)]
    tiers = spark.createDataFrame(checks, "url string, tier string, t int").withColumn("checked_at", F.timestamp_seconds("t"))
    assert {r.url: r.tier for r in V.verification_join(entries, tiers).collect()} == {"u1": "blocked", "u2": "live", "u3": "dead", "u4": "stale"}


def test_a_failed_index_write_leaves_the_old_index(spark, tmp_path):
    path = str(tmp_path / "index")
    entries = I.index_entry(spark.createDataFrame([("a.md", "2024-01-01", True)], "path string, published string, enriched boolean"))
    I.sink_index(entries, path)
    with pytest.raises(Exception):
        I.sink_index(entries.withColumn("title", F.raise_error(F.lit("stop"))), path)
    assert [r.path for r in I.scan_index(spark, path).collect()] == ["a.md"]
    I.sink_index(entries.withColumn("path", F.lit("b.md")), path)
    assert [r.path for r in I.scan_index(spark, path).collect()] == ["b.md"]
    I.sink_index(entries.limit(0), path)
    assert I.scan_index(spark, path).count() == 0


def test_a_refresh_writes_only_the_months_it_names(spark, tmp_path):
    """Other months keep their files; an emptied month and added columns read as they should."""
    path = str(tmp_path / "index")

    def entries(*rows):
        return I.index_entry(spark.createDataFrame([(p, d, True) for p, d in rows], "path string, published string, enriched boolean"))

    def files(month):
        return sorted(f.name for f in (tmp_path / "index" / f"month={month}").glob("*.parquet"))

    I.sink_index(entries(("a.md", "2024-01-05"), ("b.md", "2024-02-05"), ("c.md", None)), path)
    before = files("2024-01")
    I.overwrite_months(entries(("d.md", "2024-03-01")).withColumn("generated", F.lit("now")), path, ["2024-02"])
    assert files("2024-01") == before
    assert {(r.path, r.month, r.generated) for r in I.scan_index(spark, path).collect()} == {
        ("a.md", "2024-01", None), ("c.md", "0000-00", None), ("d.md", "2024-03", "now")}
    assert I.index_months(spark, path) == ["0000-00", "2024-01", "2024-02", "2024-03"]
    I.sink_index(entries(("e.md", "2024-02-01")), path)
    assert [(r.path, r.month) for r in I.scan_index(spark, path).collect()] == [("e.md", "2024-02")]


def test_entities_and_unknown_frontmatter_are_kept(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: x\nenriched: true\nreviewed_by: me\nentities:\n  organizations: [Acme]\n  people: []\n  venues: [Hall]\n---\nb\n")
    docs, _ = SC.scan_documents(spark, str(tmp_path))
    typed = I.documents_from_markdown(docs)
    entry = I.index_from_documents(typed).first()
    assert entry.entities == {"organizations": ["Acme"], "venues": ["Hall"]}
    assert '"reviewed_by":"me"' in typed.first().frontmatter


@pytest.mark.parametrize("raw,day", [
    ("Wednesday, 22 May 2024 10:00:00 GMT", "2024-05-22"), ("22 May 2024", "2024-05-22"), ("May 22, 2024", "2024-05-22"),
    ("Wed, 22 May 24 10:00:00 GMT", "2024-05-22"), ("Wed, 22 May 2024 23:30:00 -0500", "2024-05-23"), ("3-Sep-2024", "2024-09-03"), ("no date", "2024-02-01")])
def test_feed_dates(spark, raw, day):
    assert spark.range(1).select(parse_pub_date(F.lit(raw)).alias("d")).first().d == day


def test_entities_and_folding_as_in_python(spark):
    import html
    texts = ["It&#8217;s &eacute;t&#233;", "&amp;lt; &amp;#8217;", "&#150; &#x41; &#38;lt;", "&notit; &copy", "no entity & more", "&#55296; &#0;"]
    folds = ["Straße", "ΣΊΣΥΦΟΣ", "ŉ ſ µ ǰ", "İ", "ÀÉ", "ﬁ"]
    df = spark.createDataFrame(list(zip(texts, folds)), "t string, f string")
    for r in df.select("t", "f", TX.unescape(F.col("t")).alias("u"), TX.casefold(F.col("f")).alias("c"), TX.casefold_array(F.array("f")).alias("cs")).collect():
        assert (r.u, r.c, r.cs) == (html.unescape(r.t), r.f.casefold(), [r.f.casefold()])


def test_entity_lists_are_deduped_by_first_spelling(spark):
    df = spark.createDataFrame([(["b", "A", "a", "STRASSE", "straße", "x"],), (None,), ([],)], "e array<string>")
    got = [r.n for r in df.select(R.normalize_list(F.col("e"), R.alias_map([("X", "Canon")])).alias("n")).collect()]
    assert got == [["A", "Canon", "STRASSE", "b"], None, []]


def test_retries_bound_the_attempts(spark):
    rows = [("p", n, n == 3, [] if n == 3 else [f"e{n}"]) for n in (1, 2, 3)]
    df = spark.createDataFrame(rows, "path string, attempt int, ok boolean, errors array<string>")
    assert R.first_valid_attempt(df).first().ok
    failed = R.first_valid_attempt(df, retries=1)
    assert [tuple(r) for r in R.batch_failures(failed).collect()] == [("p", ["e1", "e2"])]


def test_arrow_functions_work_from_another_folder(tmp_path):
    """A session made elsewhere, without PYTHONPATH: its workers import the package that the session ships."""
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from pyspark.sql import SparkSession, functions as F\n"
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "from tidepool.session import prepare\n"
            "prepare(s)\n"
            "from tidepool.sources.scans import yaml_to_json\n"
            "print(s.createDataFrame([('a: 1',)], 'x string').select(yaml_to_json(F.col('x')).alias('j')).first().j)\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code % root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert out.stdout.strip() == '{"a": 1}', out.stderr[-2000:]
