"""Plan guards: the physical properties the scale design relies on."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan_of(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,must", [
    ("window_query", ["TakeOrderedAndProject"]),
    ("window_query_stored", ["TakeOrderedAndProject", "PartitionFilters", "GreaterThanOrEqual(published"]),
    ("limit_per_source", ["WindowGroupLimit", "BroadcastHashJoin"]),
    ("backlog_cap", ["TakeOrderedAndProject"]),
    ("cost_estimate", ["BroadcastHashJoin"]),
])
def test_expected_operators(spark, name, must):
    plan = plan_of(spark, name)
    for op in must:
        assert op in plan, (name, op)


@pytest.mark.parametrize("name", ["window_query", "limit_per_source", "leak_scan", "status_tier", "url_guard",
                                  "resolve_link", "first_wins_dedup", "throttle_wait", "group_by_topic",
                                  "normalize_entities", "validate_record", "ingest_listing"])
def test_no_pairwise_joins_and_no_python_where_native(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan                     # never row-at-a-time Python
    if name in ("status_tier", "url_guard", "resolve_link", "leak_scan"):
        assert "ArrowEvalPython" not in plan                  # these paths are fully native
    if name == "ingest_listing":                              # rare HTML entities in titles, and nothing else
        assert all("unescape_full(CASE WHEN" in x for x in plan.splitlines() if "ArrowEvalPython" in x)


def _ancestors(plan, leaf):
    """Operator names above the first plan line that holds ``leaf``, nearest first."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if leaf in x)

    def depth(x):
        return len(x) - len(x.lstrip(" :+-*()0123456789"))
    found, level = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < level:
            level = depth(x)
            found.append(x.lstrip(" :+-*()0123456789"))
    return found


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_adapters_shuffle_no_large_side(spark, limit):
    """However many items are possible, seen files and bodies meet a Bloom filter before any exchange."""
    from pyspark.sql import functions as F
    from tidepool.operators import ingest as G
    from tidepool.plans import fixtures as fx
    reg = fx.registry_from_sources(spark.createDataFrame([("src4",), ("src3",), ("src0",)], "source string")).withColumn("scrape_limit", F.lit(limit))
    pages = spark.createDataFrame([(1, "src4", "https://s/blog/", '<a href="/posts/en-report_1">x</a>')], "page_id long, source string, feed_url string, html string")
    seen = spark.range(50_001).selectExpr("'ns0' as namespace", "cast(id as string) as file_name")
    fetched = spark.range(50_002).selectExpr("concat('https://s/posts/en-report_', id) as url", "repeat('word ', 200) as body")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = G.ingest_listing_items(pages, reg, seen, fetched)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for leaf in ("Range (0, 50001", "Range (0, 50002"):
        above = _ancestors(plan, leaf)
        first = next(x for x in above if x.startswith(("Exchange", "BroadcastHashJoin", "SortMergeJoin")))
        assert first.startswith("BroadcastHashJoin"), (leaf, above)


def test_updating_documents_moves_no_bodies(spark, tmp_path):
    """The document side of the upsert is read in its buckets: its first exchange, join or write is the join."""
    from tidepool.sources import doctable as DT
    docs = spark.range(40).selectExpr("concat('p', id) AS path", "'2024-01-05' AS published", "repeat('b', 50) AS body")
    table = DT.store_documents(docs, "plan_documents", str(tmp_path / "docs"))
    res = spark.createDataFrame([("p1", True, (True, "s"))], "path string, ok boolean, clean struct<enriched: boolean, summary: string>")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        clean = res.selectExpr("path", "ok", "named_struct('enriched', clean.enriched, 'summary', clean.summary, 'topics', CAST(NULL AS struct<primary: array<string>, secondary: array<string>>), "
                               "'entities', CAST(NULL AS struct<organizations: array<string>, people: array<string>>), 'key_takeaways', CAST(NULL AS array<string>)) AS clean")
        plan = DT.merged_documents(spark, table, clean)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    scan = next(x for x in plan.splitlines() if "Scan parquet" in x and "body#" in x)
    first = next(x for x in _ancestors(plan, scan.strip()) if x.startswith(("Exchange", "SortMergeJoin")))
    assert first.startswith("SortMergeJoin"), plan
    spark.sql(f"DROP TABLE {table}")


def test_feeds_are_scanned_and_parsed_once(spark):
    from tidepool.sources.scans import scan_feed_raw
    feeds = spark.range(50_003).selectExpr("id", "concat('<rss><channel><item><title>', id, '</title></item></channel></rss>') AS xml")
    plan = scan_feed_raw(feeds)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 50003") == 1 and plan.count("from_xml") <= 1 and "Union" not in plan


def test_alias_lookup_is_a_join(spark):
    assert "Join" in plan_of(spark, "alias_join")


def test_bloom_filter_holds_every_key_and_few_others(spark):
    from pyspark.sql import functions as F
    from tidepool.operators import bloom as B
    words = B.words_for(20_000)
    keys = spark.range(20_000).selectExpr("concat('k', id) AS k", "id % 7 AS n").union(spark.createDataFrame([(None, 1)], "k string, n long"))
    big = spark.range(60_000).selectExpr("concat('k', id) AS k", "id % 7 AS n", "id", "1 AS _x")
    passed = B.might_hold(big, B.bloom_of(keys, ["k", "n"], words), ["k", "n"], words)
    assert passed.columns == big.columns
    assert passed.where("id < 20000").count() == 20_000 and passed.where("id >= 20000").count() < 2_000
    full = B.bloom_of(keys, ["k", "n"], 1)  # a filter far too small still loses nothing
    assert full.count() == 1 and B.might_hold(big, full, ["k", "n"], 1).where(F.col("id") < 20_000).count() == 20_000
    assert B.words_for(None) == B.words_for(10 ** 12) == B.MAX_WORDS
