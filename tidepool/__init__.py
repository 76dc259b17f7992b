"""tidepool — a Spark-native feed → enrich → index → digest engine.

Every operator is a DataFrame → DataFrame (or Column → Column) function so
Catalyst sees the whole plan: filters reach the parquet scan, small fixed
dimensions are broadcast, per-group limits become WindowGroupLimit and
top-k reads become TakeOrderedAndProject.

Layout
------
functions/  Column → Column expressions (text, URLs, dates, records)
sources/    scans of raw inputs and the sinks that write results
operators/  table-level transforms (ingest, validate, index, query, digest, audit)
plans/      the jobs composed from operators, the fixture views and the query catalog
streaming/  the incremental (availableNow) versions of ingest, dedup, backlog and index
"""

__all__ = ["session"]
