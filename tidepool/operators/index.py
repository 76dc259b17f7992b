"""Index: enriched filter, entry projection, global order, parquet sink/scan.

The index is stored as parquet partitioned by ``month`` (``YYYY-MM`` of
``published``; entries without a date live in month ``0000-00``), sorted by
the index order inside each file.  Window queries then prune months and
push the ``published`` bounds into the row-group statistics.

Writes are Spark's own dynamic partition overwrites: tasks write beside the
index, and only the committed job puts the new months in the place of the old
ones, so a failed write leaves the index as it was and a refresh touches only
the months it names.  A month that has lost its last entry is overwritten by a
row without a path, which readers skip.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.query import NO_DATE_MONTH, index_order_keys
from tidepool.session import cut_lineage


def filter_enriched(docs: DataFrame) -> DataFrame:
    """Keep rows whose ``enriched`` is exactly true (null / false dropped)."""
    return docs.where(F.coalesce(F.col("enriched"), F.lit(False)))


def filter_backlog(docs: DataFrame) -> DataFrame:
    """Complement of :func:`filter_enriched`; unreadable rows (null) count as backlog."""
    return docs.where(~F.coalesce(F.col("enriched"), F.lit(False)))


def path_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def index_entry(docs: DataFrame) -> DataFrame:
    """Project enriched documents to index entries with defaults.

    title → file stem when empty; source/url/published/summary → ''; missing
    topic or tag lists → [].  ``entities`` is an open map of category → names
    (a struct of known categories becomes one; missing → empty).
    """
    empty = F.array().cast("array<string>")
    cols = set(docs.columns)

    def opt(name, default):
        return F.col(name) if name in cols else default

    entities = F.create_map().cast("map<string,array<string>>")
    if "entities" in cols:
        kind = docs.schema["entities"].dataType
        if kind.typeName() == "struct":
            made = F.create_map(*[x for g in kind.fieldNames() for x in (F.lit(g), F.col("entities")[g])])
            made = F.map_filter(made, lambda k, names: F.size(F.coalesce(names, empty)) > 0)
        else:
            made = F.col("entities")
        entities = F.coalesce(made, entities)

    return filter_enriched(docs).select(
        F.col("path"),
        F.coalesce(F.nullif(opt("title", F.lit(None).cast("string")), F.lit("")), path_stem(F.col("path"))).alias("title"),
        F.coalesce(opt("source", F.lit("")), F.lit("")).alias("source"),
        F.coalesce(opt("url", F.lit("")), F.lit("")).alias("url"),
        F.coalesce(opt("published", F.lit("")), F.lit("")).alias("published"),
        F.coalesce(opt("tags", empty), empty).alias("tags"),
        F.coalesce(opt("primary_topics", empty), empty).alias("primary_topics"),
        F.coalesce(opt("secondary_topics", empty), empty).alias("secondary_topics"),
        F.coalesce(opt("summary", F.lit("")), F.lit("")).alias("summary"),
        entities.alias("entities"),
        F.lit(True).alias("enriched"))


def month_of(published: Column) -> Column:
    p = F.coalesce(published, F.lit(""))
    return F.when(p.rlike(r"^\d{4}-\d{2}"), F.substring(p, 1, 7)).otherwise(F.lit(NO_DATE_MONTH))


def global_rank(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """1-based position in a total order, without funnelling rows into one task.

    The frame is range-partitioned and sorted (a hot key value is split
    across ranges by the full sort key), numbered within each partition, and
    frozen with a reliable checkpoint.  Per-partition counts — one row per
    partition, a bound set by the partition count — give the offsets.
    """
    tagged = (df.orderBy(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = cut_lineage(tagged)
    per_part = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    offsets = per_part.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    out = tagged.join(F.broadcast(offsets.select("_pid", "_first", "_off")), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("long")) \
        .drop("_pid", "_mid", "_first", "_off")


def index_order(entries: DataFrame) -> DataFrame:
    """Entries with their global index position (published desc, path parts asc)."""
    return global_rank(entries, index_order_keys())


def backlog_cap(docs: DataFrame, n: int) -> DataFrame:
    """First ``n`` backlog documents by path parts (0 = all), numbered.

    A top-k on the path: TakeOrderedAndProject keeps ``n`` rows per task.
    """
    backlog = filter_backlog(docs)
    key = F.split(F.col("path"), "/")
    capped = backlog.orderBy(key).limit(n) if n > 0 else backlog
    if n > 0:
        return capped.withColumn("rank", F.row_number().over(Window.orderBy(key)).cast("long"))
    return global_rank(capped, [key])


def sink_index(entries: DataFrame, path: str, generated: str | None = None) -> str:
    """Write the index as parquet partitioned by month, sorted within files.

    ``generated`` (a run parameter, e.g. an ISO timestamp) is stored with
    every entry.  Months of the index before that hold no entry any more are emptied.
    """
    if generated is not None:
        entries = entries.withColumn("generated", F.lit(generated))
    overwrite_months(entries, path, [NO_DATE_MONTH, *index_months(entries.sparkSession, path)])
    return path


def overwrite_months(entries: DataFrame, path: str, months: list[str]) -> None:
    """Replace the months of ``entries``, and those named, by ``entries``; other months stay.

    ``entries`` may come from the index itself: the old files go when the job commits.
    """
    stamped = entries.withColumn("month", month_of(F.col("published")))
    emptied = entries.sparkSession.createDataFrame([(m,) for m in sorted(set(months))], "month string")
    (stamped.unionByName(emptied, allowMissingColumns=True)
     .repartition("month", F.substring("path", 1, 64))
     .sortWithinPartitions("month", *index_order_keys())
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the index with every month's columns, or None where there is no index."""
    try:
        found = spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    fields = [T.StructField("month", T.StringType()) if f.name == "month" else f for f in found.schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def index_months(spark: SparkSession, path: str) -> list[str]:
    """The months of an index ([] when there is none); only the folders' names are read."""
    rows = _stored(spark, path)
    return [] if rows is None else sorted(r["month"] for r in rows.select("month").distinct().collect())


def scan_index(spark: SparkSession, path: str) -> DataFrame:
    """Read an index (partition column ``month``)."""
    rows = _stored(spark, path)
    if rows is None:
        raise FileNotFoundError(f"no index at {path}")
    return rows.where(F.col("path").isNotNull())


def export_index_json(index: DataFrame, path: str) -> str:
    """JSON lines export, one entry per line (never one document holding every entry)."""
    index.drop("month").write.mode("overwrite").json(path)
    return path


# ---------------------------------------------------------------------------
# Documents (scanned Markdown or ingest output) → the typed document table
# ---------------------------------------------------------------------------

def documents_from_markdown(scanned: DataFrame) -> DataFrame:
    """Scanned files (path, meta VARIANT, body) → typed documents.

    Strings are taken as text (other scalars stringified, e.g. YAML dates);
    list fields go through ``ensure_list``; ``topics``/``entities`` that are
    not mappings become empty; ``enriched`` is true only for the boolean true.
    ``entity_groups`` holds every entity category as a map, ``frontmatter`` the
    whole frontmatter as JSON, so keys this table does not know are kept.
    """
    from tidepool.sources.scans import ensure_list, meta_bool_true, meta_str
    from tidepool.operators.records import py_type

    def sub(field, key):
        x = F.try_variant_get(F.col("meta"), f"$.{field}", "variant")
        return F.when(py_type(x) == "dict", ensure_list(F.try_variant_get(x, f"$.{key}", "variant"))) \
            .otherwise(F.array().cast("array<string>"))

    tags = ensure_list(F.try_variant_get(F.col("meta"), "$.tags", "variant"))
    kt = F.try_variant_get(F.col("meta"), "$.key_takeaways", "variant")
    return scanned.select(
        "path",
        meta_str("title").alias("title"), meta_str("source").alias("source"), meta_str("url").alias("url"),
        meta_str("published").alias("published"), tags.alias("tags"), meta_str("perspective").alias("perspective"),
        F.col("body"),
        meta_bool_true("enriched").alias("enriched"), meta_str("summary").alias("summary"),
        F.struct(sub("topics", "primary").alias("primary"), sub("topics", "secondary").alias("secondary")).alias("topics"),
        F.struct(sub("entities", "organizations").alias("organizations"),
                 sub("entities", "people").alias("people")).alias("entities"),
        F.when(kt.isNotNull(), ensure_list(kt)).alias("key_takeaways"),
        _entity_map().alias("entity_groups"), F.to_json(F.col("meta")).alias("frontmatter"))


def _entity_map() -> Column:
    """Every category of the frontmatter's ``entities`` mapping with its names."""
    from tidepool.operators.records import py_type
    from tidepool.sources.scans import ensure_list
    ents = F.try_variant_get(F.col("meta"), "$.entities", "variant")
    groups = F.try_variant_get(F.when(py_type(ents) == "dict", ents), "$", "map<string,variant>")
    listed = F.transform_values(groups, lambda k, v: ensure_list(v))
    return F.map_filter(listed, lambda k, names: F.size(names) > 0)


def documents_from_ingest(new_docs: DataFrame) -> DataFrame:
    """Ingest output (namespace, file_name, title, source, link, date, tags,
    perspective, content) → typed documents, not yet enriched."""
    empty = F.array().cast("array<string>")
    return new_docs.select(
        F.concat("namespace", F.lit("/"), "file_name").alias("path"), "title", "source",
        F.col("link").alias("url"), F.col("date").alias("published"), "tags", "perspective",
        F.col("content").alias("body"), F.lit(None).cast("boolean").alias("enriched"),
        F.lit(None).cast("string").alias("summary"),
        F.struct(empty.alias("primary"), empty.alias("secondary")).alias("topics"),
        F.struct(empty.alias("organizations"), empty.alias("people")).alias("entities"),
        F.lit(None).cast("array<string>").alias("key_takeaways"))


def index_from_documents(docs: DataFrame) -> DataFrame:
    """Typed documents → index entries (enriched only, defaults applied)."""
    flat = docs.withColumn("primary_topics", F.col("topics.primary")).withColumn("secondary_topics", F.col("topics.secondary"))
    if "entity_groups" in docs.columns:
        flat = flat.withColumn("entities", F.col("entity_groups"))
    return index_entry(flat)
