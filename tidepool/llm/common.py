"""Small helpers shared by the operators: staged tables, the shared store."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepool import session
from tidepool.session import scratch_path

__all__ = ["documents", "letters_present", "open_store", "read_table", "scratch_path", "staged", "unstaged"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, in a session that is made ready first: executors can import this package."""
    return session.read_table(session.prepare(spark), sf_dir, name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage (a lost executor never repeats what lies before) and
    gives later joins a plain scan on this side, so adaptive execution can
    split a skewed partition of it.  With ``by``, one folder for each value of
    that column: reading one value leaves the others unread.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._staged_at = path
    return made


def unstaged(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def letters_present(text) -> object:
    """True where a text holds at least one letter of any script."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def open_store(uri: str):
    """(file system, path) of a URI or plain path."""
    from pyarrow import fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri)))
    return fs.LocalFileSystem(), uri
