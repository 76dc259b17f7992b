"""The user-facing jobs over stored tables.

Each job reads its inputs from paths (parquet unless stated), runs one
declarative plan built from :mod:`tidepool.operators`, and writes through
Spark's writers.  These are the calls a pipeline run makes; the checked
queries in ``catalog_*.py`` exercise the same operators on stand-in inputs.

Table layouts
-------------
feeds      (source, xml)                       raw RSS/Atom documents, one row per fetched feed
pages      (page_id, source, feed_url, html)   listing pages
videos     (line_no, source, line)             video-listing JSON lines
segments   (video, seq, segment, track)        caption segments
registry   see :data:`tidepool.contracts.REGISTRY_SCHEMA`
seen       (namespace, file_name)              documents already written (any date prefix)
fetched    (url, body)                         fetched article bodies, one per url
documents  (namespace, file_name, doc_text, …) written by :func:`ingest`
responses  (path, attempt, raw)                model answers
index      month-partitioned parquet written by :func:`build_index`
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool import contracts as C
from tidepool.operators import audit as A
from tidepool.operators import digest as D
from tidepool.operators import enrich as EN
from tidepool.operators import index as I
from tidepool.operators import ingest as G
from tidepool.operators import query as Q
from tidepool.operators import records as R
from tidepool.operators import verify as V
from tidepool.session import cut_lineage, prepare
from tidepool.sources import doctable as DT
from tidepool.sources import scans as SC
from tidepool.sources import sinks as SK


def _today(run_date: str | None) -> str:
    """The run date: given, or today's date on the driver (jobs, not checked queries)."""
    import datetime as _dt
    return run_date or _dt.date.today().isoformat()


def _read(spark: SparkSession, path_or_df) -> DataFrame:
    prepare(spark)
    return path_or_df if isinstance(path_or_df, DataFrame) else spark.read.parquet(path_or_df)


# J1 ------------------------------------------------------------------------
def ingest(spark: SparkSession, registry, seen, fetched, out_path: str, *, feeds=None, pages=None,
           videos=None, segments=None, run_date: str | None = None) -> DataFrame:
    """Run the adapters that have input (each on the sources of its type), keep the
    first document of each (namespace, stem) across them and append them to ``out_path`` (parquet partitioned by namespace).  Returns the new
    new documents (namespace, file_name, source, url, date, doc_text), frozen by
    a reliable checkpoint so using them does not rerun the adapters."""
    run_date = _today(run_date)
    reg, seen_df, fetched_df = (_read(spark, x) for x in (registry, seen, fetched))
    parts = []
    if feeds is not None:
        raw = SC.scan_feed_raw(_read(spark, feeds))
        parts.append(G.ingest_feed_items(raw, reg, seen_df, fetched_df, run_date).withColumn("url", F.col("link")))
    if pages is not None:
        parts.append(G.ingest_listing_items(_read(spark, pages), reg, seen_df, fetched_df, run_date))
    if videos is not None and segments is not None:
        parts.append(G.ingest_video_items(_read(spark, videos), _read(spark, segments), reg, seen_df, run_date))
    if not parts:
        raise ValueError("no adapter input given")
    cols = ["namespace", "file_name", "source", "url", "date", "doc_text"]
    keyed = [p.select(*cols, "stem", "source_ord") for p in parts]
    docs = cut_lineage(G.first_across_adapters(*keyed).select(*cols))
    SK.sink_documents(docs, out_path)
    return docs


def dry_run(spark: SparkSession, feeds, registry) -> DataFrame:
    """Per-source item counts a run would scrape (nothing written)."""
    entries = SC.scan_feed_raw(_read(spark, feeds)).select("source")
    return A.dry_run_preview(entries, _read(spark, registry))


# J2 ------------------------------------------------------------------------
def enrichment_packets(spark: SparkSession, docs, vocabulary, out_path: str, max_enrich: int = 0) -> DataFrame:
    """Work packets for the (capped) backlog, written as JSON lines."""
    backlog = I.backlog_cap(_read(spark, docs), max_enrich)
    packets = EN.build_packets(backlog, vocabulary)
    SK.sink_packets(packets, out_path)
    return packets


def enrich(spark: SparkSession, docs, vocabulary, enrich_fn, model: str, max_enrich: int = 0) -> DataFrame:
    """Run a user enricher (``content -> (raw, usage)``) over the capped backlog."""
    backlog = I.backlog_cap(_read(spark, docs), max_enrich)
    return EN.enrich_with(backlog, enrich_fn, model)


# J3 ------------------------------------------------------------------------
def writeback(spark: SparkSession, docs, responses, vocabulary, aliases, out_path: str,
              failed_queue: str) -> DataFrame:
    """Validate/normalise/sanitise answers, upsert successful ones into the
    documents (written to ``out_path``), append failures to the queue."""
    res = cut_lineage(R.writeback(_read(spark, responses), vocabulary, aliases))  # used three times below
    SK.sink_failed_queue(res.where(~F.col("ok")), failed_queue)
    merged = R.upsert_metadata(_read(spark, docs), res)
    merged.write.mode("overwrite").parquet(out_path)
    return R.batch_report(res)


def writeback_documents(spark: SparkSession, table: str, responses, vocabulary, aliases, failed_queue: str) -> DataFrame:
    """As :func:`writeback`, into a document table (:mod:`tidepool.sources.doctable`): bodies
    are not moved, and only the months of updated documents are written."""
    res = cut_lineage(R.writeback(_read(spark, responses), vocabulary, aliases))  # used three times below
    SK.sink_failed_queue(res.where(~F.col("ok")), failed_queue)
    DT.upsert_documents(spark, table, res)
    return R.batch_report(res)


# J4 ------------------------------------------------------------------------
def build_index(spark: SparkSession, docs, out_path: str, generated: str | None = None) -> str:
    """Index entries of the enriched documents, month-partitioned and ordered;
    ``generated`` defaults to the current UTC time (a driver-side stamp)."""
    import datetime as _dt
    stamp = generated or _dt.datetime.now(_dt.timezone.utc).isoformat()
    d = _read(spark, docs)
    # the typed document table carries topics as a struct; flat inputs carry the lists
    entries = I.index_from_documents(d) if "topics" in d.columns else I.index_entry(d)
    return I.sink_index(entries, out_path, generated=stamp)


def build_index_from_markdown(spark: SparkSession, content_root: str, out_path: str,
                              generated: str | None = None) -> tuple[str, DataFrame]:
    """Index of a folder tree of Markdown documents (YAML frontmatter).
    Returns the index path and the quarantined (unreadable) file paths."""
    import datetime as _dt
    docs, bad = SC.scan_documents(spark, content_root)
    entries = I.index_from_documents(I.documents_from_markdown(docs))
    stamp = generated or _dt.datetime.now(_dt.timezone.utc).isoformat()
    return I.sink_index(entries, out_path, generated=stamp), bad


def markdown_backlog(spark: SparkSession, content_root: str) -> DataFrame:
    """Paths that need enrichment under a Markdown tree: readable documents not
    marked ``enriched: true``, plus unreadable ones (re-queued every run).
    Returns (path, readable)."""
    docs, bad = SC.scan_documents(spark, content_root)
    typed = I.documents_from_markdown(docs)
    pending = I.filter_backlog(typed).select("path", F.lit(True).alias("readable"))
    return pending.unionByName(bad.select("path", F.lit(False).alias("readable")))


# J5 / J6 ---------------------------------------------------------------------
def window(spark: SparkSession, index_path: str, *, since=None, until=None, topic=None, source=None,
           limit: int = C.WINDOW_LIMIT, run_date: str | None = None) -> DataFrame:
    """Newest entries matching the filters; ``since`` may be 'Nd' (run_date − N days)."""
    run_date = _today(run_date)
    return Q.window_query(I.scan_index(spark, index_path), since=Q.parse_bound(since, run_date),
                          until=Q.parse_bound(until, run_date), topic=topic, source=source, limit=limit)


def digest(spark: SparkSession, index_path: str, *, since=None, until=None, limit: int = C.WINDOW_LIMIT,
           checks=None, dns=None, run_date: str | None = None, out_path: str | None = None) -> DataFrame:
    """The topic-grouped digest lines; with ``checks`` (url, status) and ``dns``
    (host, ip) links carry verification tiers.  Optionally written as text."""
    run_date = _today(run_date)
    tiers = None
    if checks is not None:
        tiers = V.check_tiers(_read(spark, checks), _read(spark, dns))
    lines = D.digest(I.scan_index(spark, index_path), since=Q.parse_bound(since, run_date),
                     until=Q.parse_bound(until, run_date), limit=limit, run_date=run_date, checks=tiers)
    if out_path:
        SK.sink_digest(lines, out_path)
    return lines


# J7 – J9 ---------------------------------------------------------------------
def link_audit(spark: SparkSession, checks, dns) -> DataFrame:
    """(url, status) → guard reason and tier per url."""
    return V.check_tiers(_read(spark, checks), _read(spark, dns))


def crawl_audit(spark: SparkSession, fetch_log) -> DataFrame:
    """Throttle spacing of a fetch log (group, start/end µs, throttle µs)."""
    return A.throttle_wait(_read(spark, fetch_log))


def leak_scan(spark: SparkSession, docs, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return A.leak_scan(_read(spark, docs), text_col=text_col, id_col=id_col)
