"""Index filters and the windowed top-k query.

The index table may be a plain DataFrame or a parquet table partitioned by
``month`` (see :mod:`tidepool.operators.index`); when the ``month`` column
is present the date bounds are also applied to it so the scan prunes
partitions (pruning is not inferred from ``published`` alone).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool import contracts as C

NO_DATE_MONTH = "0000-00"  # partition of entries without a published date


def published_or_empty(df: DataFrame) -> Column:
    return F.coalesce(df["published"], F.lit(""))


def filter_date_range(df: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Inclusive string bounds; empty/None bounds are ignored.

    A missing date is '' — it fails ``since`` and passes ``until``.
    """
    # Written without coalesce so both bounds reach the parquet scan as
    # pushed filters: a null date fails `since` and passes `until`.
    p = F.col("published")
    has_month = "month" in df.columns
    if since:
        df = df.where(p >= since)
        if has_month:
            # dates that do not start with a year and month share one partition, which no bound prunes
            df = df.where((F.col("month") >= since[:7]) | (F.col("month") == NO_DATE_MONTH))
    if until:
        df = df.where((p <= until) | p.isNull())
        if has_month:
            df = df.where((F.col("month") <= until[:7]) | (F.col("month") == NO_DATE_MONTH))
    return df


def all_topics(primary: Column, secondary: Column) -> Column:
    """primary + secondary as a bag (repeats kept)."""
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(primary, empty), F.coalesce(secondary, empty))


def filter_topic(df: DataFrame, topic: str | None) -> DataFrame:
    if not topic:
        return df
    return df.where(F.array_contains(all_topics(F.col("primary_topics"), F.col("secondary_topics")), topic))


def filter_source(df: DataFrame, source: str | None) -> DataFrame:
    if not source:
        return df
    return df.where(F.col("source") == source)


def index_order_keys() -> list[Column]:
    """published desc (missing last), ties by path parts ascending."""
    return [F.coalesce(F.col("published"), F.lit("")).desc(), F.split(F.col("path"), "/").asc()]


def window_query(index: DataFrame, *, since: str | None = None, until: str | None = None,
                 topic: str | None = None, source: str | None = None,
                 limit: int = C.WINDOW_LIMIT) -> DataFrame:
    """Filter → newest first → first ``limit`` rows, with a 1-based ``rank``.

    Planned as a pushed-down scan + TakeOrderedAndProject: no full sort, no
    shuffle of the index; only ``limit`` rows per task travel.
    """
    if limit is None or limit < 0:
        raise ValueError("limit must be a non-negative integer")
    df = filter_source(filter_topic(filter_date_range(index, since, until), topic), source)
    keys = index_order_keys()
    top = df.orderBy(*keys).limit(limit)
    # ≤ limit rows: a single-partition window is the cheap way to number them
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def relative_since(days: int, run_date: str = C.RUN_DATE) -> str:
    """'Nd' → run_date − N days as an ISO date (computed on the driver)."""
    import datetime as _dt
    return (_dt.date.fromisoformat(run_date) - _dt.timedelta(days=days)).isoformat()


def parse_bound(value: str | None, run_date: str = C.RUN_DATE) -> str | None:
    if value and value.endswith("d") and value[:-1].isdigit():
        return relative_since(int(value[:-1]), run_date)
    return value
