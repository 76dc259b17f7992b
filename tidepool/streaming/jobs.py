"""Incremental runs with Structured Streaming (J10).

Every job reads a file source with an explicit schema, runs with
``trigger(availableNow=True)`` (process what is there, then stop — the
incremental contract of one pipeline pass) and keeps its progress in a
checkpoint location under the shared checkpoint folder, so a restarted run
resumes where the last one committed.

Sinks are written from ``foreachBatch`` so each micro-batch can use batch
operators (anti-joins, top-k, dynamic partition overwrite).  Every batch
writes to a directory named by its batch id with ``overwrite``, so a replayed
batch (after a failure) replaces its own output instead of duplicating it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepool.operators import index as I
from tidepool.operators import records as R
from tidepool.session import cut_lineage


def _run(query: StreamingQuery) -> None:
    query.awaitTermination()
    exc = query.exception()
    if exc is not None:
        raise RuntimeError(f"stream {query.name} failed: {exc}")


def _batch_dirs(root: str, exclude: int | None = None) -> list[str]:
    """Committed batch directories of a sink (the driver lists a handful of names)."""
    from pyspark import SparkContext
    sc = SparkContext.getOrCreate()
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            if exclude is None or name != f"batch={exclude}":
                out.append(st.getPath().toString())
    return sorted(out)


def _write_batch(df: DataFrame, root: str, batch_id: int, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(os.path.join(root, f"batch={batch_id}"))


def read_sink(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """All committed batches of a sink written by these jobs."""
    dirs = _batch_dirs(root)
    if not dirs:
        if schema is None:
            raise FileNotFoundError(root)
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*dirs)


# ---------------------------------------------------------------------------
# stream_ingest: pick up only new raw rows
# ---------------------------------------------------------------------------

def stream_ingest(spark: SparkSession, source_glob: str, schema: str, sink: str, checkpoint: str,
                  columns: list[str] | None = None, max_files_per_trigger: int | None = None) -> None:
    """Copy newly arrived rows (projected to ``columns``) into the sink."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_glob)
    if columns:
        src = src.select(*columns)
    q = (src.writeStream.queryName("stream_ingest")
         .foreachBatch(lambda df, bid: _write_batch(df, sink, bid))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    _run(q)


# ---------------------------------------------------------------------------
# stream_dedup: never emit a key twice, across runs
# ---------------------------------------------------------------------------

def _latest_compaction(root: str, before: int) -> tuple[str | None, int]:
    """(path, last batch id covered) of the newest committed key compaction that
    covers only batches before ``before`` (a replayed batch must not meet its own keys)."""
    best, upto = None, -1
    for d in _batch_dirs_named(os.path.join(root, "_keys"), "upto="):
        n = int(d.rstrip("/").rsplit("upto=", 1)[1])
        if upto < n < before:
            best, upto = d, n
    return best, upto


def _batch_dirs_named(root: str, prefix: str) -> list[str]:
    from pyspark import SparkContext
    sc = SparkContext.getOrCreate()
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return [st.getPath().toString() for st in fs.listStatus(path)
            if st.getPath().getName().startswith(prefix)
            and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))]


def stream_dedup(spark: SparkSession, source_glob: str, schema: str, keys: list[str], order_col: str,
                 sink: str, checkpoint: str, max_files_per_trigger: int | None = None,
                 compact_every: int = 32) -> None:
    """Emit the first row (by ``order_col``) of every key not emitted before.

    The emitted table itself is the dedup state: each batch is reduced to one
    row per key (a partial ``min_by`` aggregation) and anti-joined with the
    keys already emitted — no unbounded in-memory state store.  Every
    ``compact_every`` batches the emitted keys are compacted into one
    versioned key table (``_keys/upto=<batch>``), so a batch reads that table
    plus at most ``compact_every`` newer batch directories.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_glob)
    cols = [c for c in src.columns if c not in keys]

    def emitted_keys(before: int) -> DataFrame | None:
        comp, upto = _latest_compaction(sink, before)
        newer = [d for d in _batch_dirs(sink) if upto < int(d.rstrip("/").rsplit("batch=", 1)[1]) < before]
        parts = ([spark.read.parquet(comp)] if comp else []) + \
            ([spark.read.parquet(*newer).select(*keys)] if newer else [])
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def per_batch(df: DataFrame, batch_id: int) -> None:
        firsts = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("_r")) \
            .select(*keys, *[F.col("_r")[c].alias(c) for c in cols])
        seen = emitted_keys(batch_id)
        if seen is not None:
            firsts = firsts.join(seen, keys, "left_anti")
        _write_batch(firsts, sink, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            everything = emitted_keys(batch_id + 1)
            everything.distinct().write.mode("overwrite").parquet(os.path.join(sink, "_keys", f"upto={batch_id}"))

    q = (src.writeStream.queryName("stream_dedup").foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    _run(q)


# ---------------------------------------------------------------------------
# stream_backlog: drain model answers, capped per batch, failures re-queued
# ---------------------------------------------------------------------------

def stream_backlog(spark: SparkSession, source_glob: str, schema: str, vocabulary, aliases,
                   results_sink: str, failed_sink: str, checkpoint: str, cap_per_batch: int = 0,
                   deferred_sink: str | None = None, max_files_per_trigger: int | None = None) -> None:
    """Each batch: the answers of the first ``cap_per_batch`` paths (0 = all) are
    written back; successes go to ``results_sink``, failures to the failed
    queue.  Answers beyond the cap are written to ``deferred_sink`` (required
    with a cap), which the next run takes as input — nothing is dropped."""
    if cap_per_batch > 0 and not deferred_sink:
        raise ValueError("a per-batch cap needs a deferred_sink for the answers it defers")
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_glob)

    def per_batch(df: DataFrame, batch_id: int) -> None:
        if cap_per_batch > 0:
            keep = df.select("path").distinct().orderBy(F.split("path", "/")).limit(cap_per_batch)
            keep = F.broadcast(keep)  # ≤ cap rows: bounded by the parameter
            _write_batch(df.join(keep, "path", "left_anti"), deferred_sink, batch_id)
            df = df.join(keep, "path", "left_semi")
        res = cut_lineage(R.writeback(df, vocabulary, aliases))
        _write_batch(res.where(F.col("ok")).select("path", "attempts", "clean"), results_sink, batch_id)
        _write_batch(res.where(~F.col("ok")).select("path", "errors"), failed_sink, batch_id)

    q = (src.writeStream.queryName("stream_backlog").foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    _run(q)


# ---------------------------------------------------------------------------
# stream_index: refresh the index after every batch
# ---------------------------------------------------------------------------

def stream_index(spark: SparkSession, source_glob: str, schema: str, index_path: str, checkpoint: str,
                 max_files_per_trigger: int | None = None) -> None:
    """Merge each batch of enriched entries into the month-partitioned index.

    Of several rows of one path in a batch the last one to arrive counts.  A batch rewrites the months it writes to and those that held its paths before,
    so a document whose date moves leaves its old month (see :mod:`tidepool.operators.index`).
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_glob)

    def per_batch(df: DataFrame, batch_id: int) -> None:
        entries = I.index_entry(df).withColumn("_arrival", F.monotonically_increasing_id())
        cols = [c for c in entries.columns if c not in ("path", "_arrival")]
        new = entries.groupBy("path").agg(F.max_by(F.struct(*cols), "_arrival").alias("_e")).select("path", "_e.*")
        new = cut_lineage(new.withColumn("month", I.month_of(F.col("published"))))
        months = [r[0] for r in new.select("month").distinct().collect()]  # at most the months of the index
        if I.index_months(spark, index_path):
            old = I.scan_index(spark, index_path)
            # months that held the batch's paths: only path and month are read
            moved = old.select("path", "month").join(new.select("path"), "path", "left_semi").select("month").distinct()
            months = sorted({*months, *(r[0] for r in moved.collect())})
            kept = old.where(F.col("month").isin(months)).join(new.select("path"), "path", "left_anti")
            new = kept.unionByName(new, allowMissingColumns=True)
        I.overwrite_months(new.drop("month"), index_path, months)

    q = (src.writeStream.queryName("stream_index").foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    _run(q)
