"""Crawl and run audits (J8) and the leak scan (J9).

All aggregations here are partial (map-side combined) so a hot source,
day or model is reduced before the shuffle.  The throttle audit is a
per-group ``lag`` over rows that are range-partitioned by (group, start, id): a
hot group, even of one instant, is spread over as many tasks as its rows fill,
and only the first row of a group in a range looks up the completion before it
in a small table of one row for each (group, range).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool import contracts as C
from tidepool.session import cut_lineage

def throttle_wait(log: DataFrame, group_col: str = "throttle_group", start_col: str = "ts_us",
                  end_col: str = "end_us", throttle_col: str = "throttle_us", id_col: str = "event_id",
                  ranges: int | None = None) -> DataFrame:
    """Adds ``wait_us`` = max(0, throttle − (start − previous completion in the group)).

    No group, a zero throttle, or no previous fetch → 0.  Ordering inside a
    group is (start, id).  Rows without a group wait for nobody and take no
    part in the windows.  ``ranges`` (default: the session's shuffle partitions) is
    the number of ranges that all rows are dealt to.
    """
    spark = log.sparkSession
    free = log.where(F.col(group_col).isNull()).withColumn("wait_us", F.lit(0).cast("long"))
    log = log.where(F.col(group_col).isNotNull())
    order = [F.col(start_col), F.col(id_col)]
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The ranges' bounds are sampled: the checkpoint keeps each row in its range for good.
    df = cut_lineage(log.repartitionByRange(ranges, group_col, *order).withColumn("_b", F.spark_partition_id()))
    w = Window.partitionBy(group_col, "_b").orderBy(*order)
    df = df.withColumn("_prev_in", F.lag(end_col).over(w))
    last = df.groupBy(group_col, "_b").agg(
        F.max_by(F.col(end_col), F.struct(*order)).alias("_last_end"))
    wb = Window.partitionBy(group_col).orderBy("_b")
    carry = last.withColumn("_prev_bucket_end", F.lag("_last_end").over(wb)).drop("_last_end")
    j = df.join(carry, [group_col, "_b"], "left")
    prev = F.coalesce(F.col("_prev_in"), F.col("_prev_bucket_end"))
    active = F.col(group_col).isNotNull() & (F.coalesce(F.col(throttle_col), F.lit(0)) > 0) & prev.isNotNull()
    wait = F.when(active, F.greatest(F.lit(0), F.col(throttle_col) - (F.col(start_col) - prev))).otherwise(F.lit(0))
    return j.withColumn("wait_us", wait.cast("long")).drop("_b", "_prev_in", "_prev_bucket_end").unionByName(free)


def scrape_counts(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """New documents per source plus a 'TOTAL' row."""
    r = docs.rollup(source_col).agg(F.count(F.lit(1)).alias("new_documents"))
    return r.select(F.coalesce(F.col(source_col), F.lit("TOTAL")).alias("source"),
                    F.col("new_documents").cast("long").alias("new_documents"))


def dry_run_preview(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Per enabled source: feeds would scrape min(#entries, limit); other types their limit.
    A missing limit is the default one.  Plus a 'TOTAL' row.  Nothing is written."""
    counts = entries.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    reg = registry.where(F.col("enabled")).select(F.col("name").alias("source"), "type", "scrape_limit")
    j = reg.join(counts, "source", "left")
    limit = F.coalesce(F.col("scrape_limit"), F.lit(C.DEFAULT_SCRAPE_LIMIT))
    n = F.when(F.col("type") == "rss", F.least(F.coalesce(F.col("_n"), F.lit(0)), limit)).otherwise(limit)
    per = j.select("source", "type", n.cast("long").alias("would_scrape"))
    total = per.agg(F.sum("would_scrape").alias("would_scrape")).select(
        F.lit("TOTAL").alias("source"), F.lit(None).cast("string").alias("type"),
        F.col("would_scrape").cast("long").alias("would_scrape"))
    return per.unionByName(total)


def run_health(checks: DataFrame, run_col: str = "run", source_col: str = "source") -> DataFrame:
    """Exit status per run: 1 when every source failed (all its fetches errored),
    or when enrichment was attempted and nothing succeeded; else 0."""
    per_src = checks.groupBy(run_col, source_col).agg(
        F.bool_and(F.col("status").isNull()).alias("_failed"),
        F.count("status").alias("_attempted"),
        F.count_if((F.col("status") >= 200) & (F.col("status") < 400)).alias("_ok"))
    per_run = per_src.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.count_if(F.col("_failed")).alias("n_failed"),
        F.sum("_attempted").alias("attempted"),
        F.sum("_ok").alias("succeeded"))
    code = F.when((F.col("n_sources") > 0) & (F.col("n_failed") == F.col("n_sources")), 1) \
        .when((F.col("attempted") > 0) & (F.col("succeeded") == 0), 1).otherwise(0)
    return per_run.select(run_col, *[F.col(c).cast("long").alias(c) for c in
                                      ("n_sources", "n_failed", "attempted", "succeeded")],
                          code.cast("long").alias("exit_code"))


def usage_total(usage: DataFrame) -> DataFrame:
    """total_input = input + cache_read + cache_creation (missing buckets count 0)."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return usage.withColumn("total_input_tokens",
                            (z("input_tokens") + z("cache_read") + z("cache_creation")).cast("long"))


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Token totals per model (partial aggregation)."""
    u = usage_total(usage)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return u.groupBy("model").agg(
        F.count(F.lit(1)).cast("long").alias("calls"),
        F.sum(z("input_tokens")).cast("long").alias("input_tokens"),
        F.sum(z("cache_read")).cast("long").alias("cache_read"),
        F.sum(z("cache_creation")).cast("long").alias("cache_creation"),
        F.sum(z("output_tokens")).cast("long").alias("output_tokens"),
        F.sum("total_input_tokens").cast("long").alias("total_input_tokens"))


def price_table(spark, prices: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted(prices.items()), "model string, price double")


def cost_estimate(items_per_model: DataFrame, prices: DataFrame,
                  default: float = C.DEFAULT_ARTICLE_COST) -> DataFrame:
    """Per model: items × price (unknown model → default price).

    ``prices`` is a dimension (one row per model): broadcast after its row
    count is checked.
    """
    from tidepool.operators.ingest import checked_broadcast
    j = items_per_model.join(checked_broadcast(prices), "model", "left")
    return j.select("model", F.col("items").cast("long").alias("items"),
                    F.coalesce(F.col("price"), F.lit(default)).alias("price_per_item"),
                    (F.col("items") * F.coalesce(F.col("price"), F.lit(default))).alias("estimated_cost"))


# Default leak patterns (label, case-insensitive regex) and the
# allow-list pattern.  Portable syntax (no \b, no lookaround) so Java and
# RE2 agree.
LEAK_PATTERNS = (
    ("personal_path", r"/(Users|home)/[a-z]"),
    ("email", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"),
    ("secret_token", r"(token|secret|api[_-]?key|password)\s*=\s*\"[0-9a-z]{16,}"),
    ("ipv4_address", r"(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}($|[^0-9.])"),
    ("phone_number", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
)
# A literal every match of the pattern must contain: a cheap test that skips
# the regex on most lines (same results, far less regex work).
LEAK_HINTS = {"personal_path": "/", "email": "@", "secret_token": "=", "ipv4_address": ".", "phone_number": "+"}
LEAK_ALLOW = r"noreply@"


def leak_scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
              patterns=LEAK_PATTERNS, allow: str | None = LEAK_ALLOW) -> DataFrame:
    """One row per (document, line, label) where a pattern matches the line
    case-insensitively and the line is not allow-listed; line numbers are 1-based.

    Patterns are a driver-side list, compiled into one narrow projection
    (no join): each line is tested against every pattern in the same task.
    """
    lines = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("_i", "line"))
    if allow:
        lines = lines.where(~F.col("line").rlike("(?i)" + allow))
    def hit(lbl, p):
        test = F.col("line").rlike("(?i)" + p)
        hint = LEAK_HINTS.get(lbl) if patterns is LEAK_PATTERNS else None
        return (F.contains(F.col("line"), F.lit(hint)) & test) if hint else test
    labels = F.array(*[F.when(hit(lbl, p), F.lit(lbl)) for lbl, p in patterns])
    hits = lines.select(id_col, (F.col("_i") + 1).cast("long").alias("line_no"),
                        F.explode(F.filter(labels, lambda x: x.isNotNull())).alias("label"))
    return hits


def leak_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("label").agg(F.count(F.lit(1)).cast("long").alias("hits"))
