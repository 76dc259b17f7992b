"""Incremental runs equal batch runs, also across a restart from the checkpoint."""

from tidepool.operators import index as I
from tidepool.streaming import jobs as J

SCHEMA = "id long, k string, ts long, v string"


def _write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_dedup_stream_equals_batch_and_restarts(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / n) for n in ("src", "sink", "ckpt"))
    _write(spark, src, [(1, "a", 1, "x"), (2, "b", 2, "y"), (3, "a", 3, "z")])
    J.stream_dedup(spark, src, SCHEMA, ["k"], "ts", sink, ckpt, max_files_per_trigger=1)
    first = {r.k: r.id for r in J.read_sink(spark, sink).collect()}
    assert first == {"a": 1, "b": 2}
    # a later run sees only the new file; keys already emitted never come back
    _write(spark, src, [(4, "a", 0, "late"), (5, "c", 5, "w")])
    J.stream_dedup(spark, src, SCHEMA, ["k"], "ts", sink, ckpt, max_files_per_trigger=1)
    after = sorted((r.k, r.id) for r in J.read_sink(spark, sink).collect())
    assert after == [("a", 1), ("b", 2), ("c", 5)]
    batch = spark.read.parquet(src).groupBy("k").count().count()
    assert batch == len(after)


def test_ingest_stream_restart_reads_only_new(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / n) for n in ("src", "sink", "ckpt"))
    _write(spark, src, [(1, "a", 1, "x")])
    J.stream_ingest(spark, src, SCHEMA, sink, ckpt)
    _write(spark, src, [(2, "b", 2, "y")])
    J.stream_ingest(spark, src, SCHEMA, sink, ckpt)
    assert sorted(r.id for r in J.read_sink(spark, sink).collect()) == [1, 2]
    assert len(J._batch_dirs(sink)) == 2


def test_index_stream_merges_months(spark, tmp_path):
    schema = ("path string, title string, source string, url string, published string, tags array<string>, "
              "primary_topics array<string>, secondary_topics array<string>, summary string, enriched boolean")
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "index", "ckpt"))
    rows1 = [("a.md", "A", "s", "", "2024-01-02", [], ["x"], [], "", True),
             ("b.md", "B", "s", "", "2024-02-02", [], ["x"], [], "", True)]
    rows2 = [("a.md", "A2", "s", "", "2024-01-03", [], ["y"], [], "", True),
             ("c.md", "C", "s", "", "", [], [], [], "", True)]
    spark.createDataFrame(rows1, schema).coalesce(1).write.parquet(src)
    spark.createDataFrame(rows2, schema).coalesce(1).write.mode("append").parquet(src)
    J.stream_index(spark, src, schema, out, ckpt, max_files_per_trigger=1)
    got = {r.path: (r.title, str(r.month)) for r in I.scan_index(spark, out).collect()}
    assert got == {"a.md": ("A2", "2024-01"), "b.md": ("B", "2024-02"), "c.md": ("C", "0000-00")}


def test_backlog_cap_defers_not_drops(spark, tmp_path):
    import json
    good = {"enriched": True, "summary": "s" * 200, "topics": {"primary": ["ai"], "secondary": []},
            "entities": {"organizations": [], "people": []}}
    raw = "```yaml\n" + json.dumps(good) + "\n```"
    rows = [(i, f"p/{i}.md", 1, raw) for i in range(5)]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "doc_id long, path string, attempt int, raw string").coalesce(1).write.parquet(src)
    res, failed, deferred = (str(tmp_path / n) for n in ("ok", "failed", "deferred"))
    J.stream_backlog(spark, src, "doc_id long, path string, attempt int, raw string", {"ai"}, [], res, failed,
                     str(tmp_path / "ckpt"), cap_per_batch=2, deferred_sink=deferred)
    assert sorted(r.path for r in J.read_sink(spark, res).collect()) == ["p/0.md", "p/1.md"]
    assert sorted(r.path for r in J.read_sink(spark, deferred).collect()) == ["p/2.md", "p/3.md", "p/4.md"]


def test_dedup_compaction_keeps_exactly_once(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / n) for n in ("src", "sink", "ckpt"))
    for i in range(5):
        _write(spark, src, [(10 * i + j, f"k{(i + j) % 4}", 10 * i + j, "v") for j in range(3)])
    J.stream_dedup(spark, src, SCHEMA, ["k"], "ts", sink, ckpt, max_files_per_trigger=1, compact_every=2)
    keys = sorted(r.k for r in J.read_sink(spark, sink).collect())
    assert keys == ["k0", "k1", "k2", "k3"]
    assert J._latest_compaction(sink, 10)[1] == 3 and J._latest_compaction(sink, 3)[1] == 1


def test_replay_after_compaction_loses_nothing(spark, tmp_path):
    """The last batch is replayed when its commit is missing, although its keys are already compacted."""
    src, sink, ckpt = (str(tmp_path / n) for n in ("src", "sink", "ckpt"))
    for rows in ([(1, "a", 1, "x")], [(2, "b", 2, "y")]):
        _write(spark, src, rows)
        J.stream_dedup(spark, src, SCHEMA, ["k"], "ts", sink, ckpt, compact_every=2)
    assert J._latest_compaction(sink, 10)[1] == 1
    (tmp_path / "ckpt" / "commits" / "1").unlink()
    (tmp_path / "ckpt" / "commits" / ".1.crc").unlink(missing_ok=True)
    J.stream_dedup(spark, src, SCHEMA, ["k"], "ts", sink, ckpt, compact_every=2)
    assert sorted(r.k for r in J.read_sink(spark, sink).collect()) == ["a", "b"]


ENTRY = ("path string, title string, source string, url string, published string, tags array<string>, "
         "primary_topics array<string>, secondary_topics array<string>, summary string, enriched boolean")


def _entry(path, title, published):
    return (path, title, "s", "", published, [], ["x"], [], "", True)


def test_index_stream_follows_moved_dates_and_a_built_index(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "index", "ckpt"))
    built = spark.createDataFrame([_entry("p1.md", "old", "2024-01-05"), _entry("p2.md", "stays", "2024-01-06")], ENTRY)
    I.sink_index(I.index_entry(built), out, generated="2024-01-31T00:00:00")
    rows = [_entry("p1.md", "first", "2024-02-01"), _entry("p1.md", "last", "2024-03-01")]
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.parquet(src)
    J.stream_index(spark, src, ENTRY, out, ckpt)
    got = {r.path: (r.title, r.month) for r in I.scan_index(spark, out).collect()}
    assert got == {"p1.md": ("last", "2024-03"), "p2.md": ("stays", "2024-01")}
    assert I.scan_index(spark, out).count() == 2


def test_staged_files_grow_in_number_with_the_rows_and_batches_hold_whole_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidepool.plans import catalog_stream as S
    monkeypatch.setattr(S, "STAGED_ROWS", 50)
    seen, batch_of = {}, {}
    rows = spark.range(3000).select((F.col("id") % 1000).alias("doc_id"))
    for b, path in enumerate(S._stage(rows, "staged", spark, 3, "doc_id", 3000)):
        staged = spark.read.parquet(path).withColumn("file", F.input_file_name()).collect()
        for r in staged:
            if r.file not in seen or seen[r.file] == b:
                seen[r.file] = b
                assert batch_of.setdefault(r.doc_id, b) == b  # never in two batches
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 3000 and len(batch_of) == 1000
    assert max(sizes) <= 200 and len(sizes) > 20  # three files before, of up to 2000 rows
