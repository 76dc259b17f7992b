"""The document table: bucketed by path, partitioned by month, updated in place.

Enrichment results are few and small, documents are many and carry their bodies.
In buckets of ``path`` a join with results moves only the results, and an update
rewrites only the months that hold an updated document (dynamic partition
overwrite: the old files go when the job commits; other months keep theirs).

The files lie at ``path``; the table's name lives in the session's catalog.  A session
whose catalog does not know the table yet opens it with :func:`open_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.contracts import RECORD_SCHEMA
from tidepool.operators.index import month_of
from tidepool.operators.records import META_FIELDS, upsert_metadata


def _buckets(spark: SparkSession, buckets: int | None) -> int:
    """At least as many buckets as shuffle partitions, else a join would move the documents after all."""
    return max(buckets or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))


def store_documents(docs: DataFrame, table: str, path: str, buckets: int | None = None) -> str:
    """Write documents (``path``, ``published``, …) as table ``table`` with its files at ``path``.

    Metadata fields that the documents lack are added as nulls of the record's types, so that results fit in.
    """
    for name in META_FIELDS:
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(RECORD_SCHEMA[name].dataType))
    (docs.withColumn("month", month_of(F.col("published"))).write.format("parquet").mode("overwrite")
     .partitionBy("month").bucketBy(_buckets(docs.sparkSession, buckets), "path").sortBy("path")
     .option("path", path).option("partitionOverwriteMode", "dynamic").saveAsTable(table))
    return table


def open_documents(spark: SparkSession, table: str, path: str, buckets: int) -> str:
    """Make the files of :func:`store_documents` known as ``table`` in this session's catalog."""
    fields = [T.StructField("month", T.StringType()) if f.name == "month" else f for f in spark.read.parquet(path).schema]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "
              f"PARTITIONED BY (month) CLUSTERED BY (path) SORTED BY (path) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.catalog.recoverPartitions(table)
    return table


def merged_documents(spark: SparkSession, table: str, results: DataFrame) -> DataFrame:
    """The documents of the months that ``results`` (path, ok, clean) touch, with the results put in."""
    docs = spark.table(table)
    hit = docs.select("path", "month").join(results.where("ok").select("path"), "path", "left_semi")
    months = [r["month"] for r in hit.select("month").distinct().collect()]  # at most the months of the table
    return upsert_metadata(docs.where(F.col("month").isin(months)), results).select(*docs.columns)


def upsert_documents(spark: SparkSession, table: str, results: DataFrame) -> DataFrame:
    """Put the successful results into the table; returns it.  Nothing is written for results without a document.

    ``results`` is read several times: pass a checkpointed or stored one.
    """
    merged_documents(spark, table, results).write.insertInto(table, overwrite=True)
    spark.catalog.refreshTable(table)
    return spark.table(table)
