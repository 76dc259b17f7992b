"""Checked queries: incremental runs with Structured Streaming (J10).

Each query stages its input in several batches of parquet files (data Spark derives
from the driver tables), runs the streaming job with availableNow after each, so that
every run is a micro-batch that resumes from the checkpoint, and returns what the sink
holds afterwards.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import index as I
from tidepool.plans import fixtures as fx
from tidepool.plans.catalog import register
from tidepool.plans.oracle_views import with_views
from tidepool.session import read_table, scratch_path
from tidepool.streaming import jobs as J

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


#: Rows of one staged file, on average.
STAGED_ROWS = 20_000


def _stage(df: DataFrame, name: str, spark: SparkSession, batches: int, key: str, rows: int) -> Iterator[str]:
    """Stage ``df``, of about ``rows`` rows, batch after batch: yields the folder once each batch's files are there.

    A batch holds the rows of whole keys (``key`` modulo ``batches``), in files whose number grows
    with the rows, so that no task writes or reads a whole batch.
    """
    path = scratch_path(spark, name)
    batch = F.pmod(F.hash(F.col(key) % batches), F.lit(batches))
    for b in range(batches):
        df.where(batch == b).repartition(max(1, math.ceil(rows / (batches * STAGED_ROWS)))).write.mode("append").parquet(path)
        yield path


@register("stream_ingest", "SELECT event_id, user_id, event_type FROM events")
def q_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only new rows are picked up: the driver table streamed with availableNow."""
    sink, ckpt = scratch_path(spark, "ingest-sink"), scratch_path(spark, "ingest-ckpt")
    J.stream_ingest(spark, os.path.join(sf_dir, "events.parquet*"), EVENTS_SCHEMA, sink, ckpt,
                    columns=["event_id", "user_id", "event_type"])
    return J.read_sink(spark, sink)


@register("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def q_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, event type) keys emitted once across four micro-batches."""
    ev = read_table(spark, sf_dir, "events")
    sink, ckpt = scratch_path(spark, "dedup-sink"), scratch_path(spark, "dedup-ckpt")
    for src in _stage(ev, "dedup-src", spark, 4, "event_id", ev.count()):
        J.stream_dedup(spark, src, EVENTS_SCHEMA, ["user_id", "event_type"], "ts", sink, ckpt)
    return J.read_sink(spark, sink).select("user_id", "event_type")


RAW_SCHEMA = "doc_id long, path string, attempt int, raw string"


def _backlog_sql() -> str:
    from tidepool.plans.catalog_records import _CHECKED_SQL, _RAW_CHECKED_SQL, _RAW_FIRST_SQL
    return with_views("SELECT path, ok FROM raw_first", "v_rec",
                      extra={"checked": _CHECKED_SQL, "raw_checked": _RAW_CHECKED_SQL, "raw_first": _RAW_FIRST_SQL})


@register("stream_backlog", _backlog_sql())
def q_stream_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers drained in micro-batches: written back or queued as failed."""
    raw = fx.v_raw(spark, sf_dir)
    res, failed, ckpt = scratch_path(spark, "backlog-ok"), scratch_path(spark, "backlog-failed"), scratch_path(spark, "backlog-ckpt")
    for src in _stage(raw, "backlog-src", spark, 3, "doc_id", 3 * read_table(spark, sf_dir, "documents").count()):
        J.stream_backlog(spark, src, RAW_SCHEMA, fx.VOCABULARY, fx.ALIASES, res, failed, ckpt)
    ok = J.read_sink(spark, res).select("path", F.lit(True).alias("ok"))
    bad = J.read_sink(spark, failed).select("path", F.lit(False).alias("ok"))
    return ok.unionByName(bad)


INDEX_SRC_SCHEMA = ("doc_id long, path string, title string, source string, url string, published string, "
                    "tags array<string>, primary_topics array<string>, secondary_topics array<string>, "
                    "summary string, enriched boolean")


@register("stream_index", with_views("""
SELECT path, published, CASE WHEN regexp_matches(published, '^[0-9]{4}-[0-9]{2}') THEN substr(published, 1, 7)
                             ELSE '0000-00' END AS month
FROM v_index""", "v_index"))
def q_stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index refreshed after each of four batches (only touched months rewritten)."""
    idx = fx.v_index(spark, sf_dir)
    out, ckpt = scratch_path(spark, "index-stream"), scratch_path(spark, "index-ckpt")
    for src in _stage(idx, "index-src", spark, 4, "doc_id", read_table(spark, sf_dir, "documents").count()):
        J.stream_index(spark, src, INDEX_SRC_SCHEMA, out, ckpt)
    return I.scan_index(spark, out).select("path", "published", "month")
