"""Checked queries: crawl/run audits (J8) and the leak scan (J9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool import contracts as C
from tidepool.operators import audit as A
from tidepool.plans import fixtures as fx
from tidepool.plans.catalog import register
from tidepool.plans.oracle_views import with_views


@register("throttle_wait", with_views("""
SELECT event_id, CAST(CASE WHEN throttle_group IS NULL OR prev_end IS NULL OR throttle_us <= 0 THEN 0
                           ELSE greatest(0, throttle_us - (ts_us - prev_end)) END AS BIGINT) AS wait_us
FROM (SELECT *, lag(end_us) OVER (PARTITION BY throttle_group ORDER BY ts_us, event_id) AS prev_end FROM v_events)""",
    "v_events"))
def q_throttle_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wait each fetch owed its group: throttle − time since the previous completion."""
    return A.throttle_wait(fx.v_events(spark, sf_dir)).select("event_id", "wait_us")


@register("dry_run_preview", with_views("""
WITH per AS (
  SELECT r.name AS source, r.type,
         CAST(CASE WHEN r.type = 'rss' THEN least(coalesce(c.n, 0), coalesce(r.scrape_limit, 10)) ELSE coalesce(r.scrape_limit, 10) END AS BIGINT)
           AS would_scrape
  FROM v_registry r LEFT JOIN (SELECT source, count(*) AS n FROM v_items GROUP BY source) c ON c.source = r.name
  WHERE r.enabled)
SELECT source, type, would_scrape FROM per
UNION ALL SELECT 'TOTAL', NULL, CAST(sum(would_scrape) AS BIGINT) FROM per""", "v_items", "v_registry"))
def q_dry_run_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-source item counts a run would scrape, without writing."""
    entries = fx.v_items(spark, sf_dir).select("source")
    return A.dry_run_preview(entries, fx.v_registry(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.v_checks(spark, sf_dir)
    return c.withColumn("run", F.date_format("ts", "yyyy-MM-dd"))


@register("run_health", with_views("""
WITH per_src AS (
  SELECT strftime(ts, '%Y-%m-%d') AS run, source, bool_and(status IS NULL) AS failed, count(status) AS attempted,
         count(*) FILTER (WHERE status >= 200 AND status < 400) AS ok
  FROM v_checks GROUP BY 1, 2),
per_run AS (
  SELECT run, count(*) AS n_sources, count(*) FILTER (WHERE failed) AS n_failed, sum(attempted) AS attempted,
         sum(ok) AS succeeded FROM per_src GROUP BY run)
SELECT run, CAST(n_sources AS BIGINT) AS n_sources, CAST(n_failed AS BIGINT) AS n_failed,
       CAST(attempted AS BIGINT) AS attempted, CAST(succeeded AS BIGINT) AS succeeded,
       CAST(CASE WHEN n_sources > 0 AND n_failed = n_sources THEN 1
                 WHEN attempted > 0 AND succeeded = 0 THEN 1 ELSE 0 END AS BIGINT) AS exit_code
FROM per_run""", "v_checks"))
def q_run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit code per run day from the fetch/enrich outcomes."""
    return A.run_health(_runs(spark, sf_dir))


@register("usage_total", with_views("""
SELECT conv_id, turn, model,
       CAST(input_tokens + coalesce(cache_read, 0) + coalesce(cache_creation, 0) AS BIGINT) AS total_input_tokens
FROM v_usage""", "v_usage"))
def q_usage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = A.usage_total(fx.v_usage(spark, sf_dir))
    return u.select("conv_id", "turn", "model", "total_input_tokens")


@register("usage_rollup", with_views("""
SELECT model, CAST(count(*) AS BIGINT) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(coalesce(cache_read, 0)) AS BIGINT) AS cache_read,
       CAST(sum(coalesce(cache_creation, 0)) AS BIGINT) AS cache_creation,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(sum(input_tokens + coalesce(cache_read, 0) + coalesce(cache_creation, 0)) AS BIGINT) AS total_input_tokens
FROM v_usage GROUP BY model""", "v_usage"))
def q_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.usage_rollup(fx.v_usage(spark, sf_dir))


# Per-model prices for the cost query: the tier table plus two of the usage
# log's model names; the third model falls back to the default price.
COST_PRICES = {**C.TIER_PRICES, "user": C.TIER_PRICES["small"], "assistant": C.TIER_PRICES["large"]}


@register("cost_estimate", with_views(f"""
SELECT c.model, CAST(c.items AS BIGINT) AS items,
       CAST(coalesce(p.price, {C.DEFAULT_ARTICLE_COST}) AS DOUBLE) AS price_per_item,
       CAST(c.items AS DOUBLE) * CAST(coalesce(p.price, {C.DEFAULT_ARTICLE_COST}) AS DOUBLE) AS estimated_cost
FROM (SELECT model, count(*) AS items FROM v_usage GROUP BY model) c
LEFT JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in sorted(COST_PRICES.items()))}) p(model, price)
  ON p.model = c.model""", "v_usage"))
def q_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per model × per-item price (default 0.032 for unpriced models)."""
    per = fx.v_usage(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("items"))
    return A.cost_estimate(per, A.price_table(spark, COST_PRICES))


def _leak_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(line, '{p}', 'i') THEN '{lbl}' END" for lbl, p in A.LEAK_PATTERNS)
    return f"""
SELECT doc_id, line_no, label FROM (
  SELECT doc_id, line_no, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS label FROM (
    SELECT doc_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
  WHERE NOT regexp_matches(line, '{A.LEAK_ALLOW}', 'i'))"""


@register("leak_scan", with_views(_leak_sql()))
def q_leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that match a sensitive pattern (not allow-listed)."""
    docs = fx._tbl(spark, sf_dir, "documents")
    return A.leak_scan(docs)


@register("leak_counts", with_views(f"""
SELECT label, CAST(count(*) AS BIGINT) AS hits FROM ({_leak_sql()}) GROUP BY label"""))
def q_leak_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.leak_counts(A.leak_scan(fx._tbl(spark, sf_dir, "documents")))


@register("sink_usage_log", with_views("""
SELECT model, input_tokens, cache_read, cache_creation, output_tokens FROM v_usage""", "v_usage"))
def q_sink_usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token usage appended to the JSON-lines log and read back."""
    from tidepool.session import scratch_path
    from tidepool.sources.sinks import sink_usage_log
    u = fx.v_usage(spark, sf_dir).select("model", "input_tokens", "cache_read", "cache_creation", "output_tokens")
    path = sink_usage_log(u, scratch_path(spark, "usage"))
    return spark.read.schema("model string, input_tokens long, cache_read long, cache_creation long, "
                             "output_tokens long").json(path)
