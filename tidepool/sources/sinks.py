"""Sinks: documents, index (see operators.index), packets, failed queue, usage log, digest.

Canonical storage is parquet/JSON through Spark's writers (commit protocol:
a failed job leaves no partial output).  ``export_markdown`` additionally
writes one ``.md`` file per document for tools that read files, on any shared store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_scalar(c: Column) -> Column:
    """A JSON (and YAML) double-quoted string literal for ``c`` (null → "")."""
    return F.regexp_replace(F.to_json(F.array(F.coalesce(c.cast("string"), F.lit("")))), r"^\[|\]$", "")


def json_value(c: Column) -> Column:
    """Any value in JSON syntax (null → null), one line."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def render_document(title: Column, source: Column, url: Column, published: Column, tags: Column,
                    perspective: Column, body: Column, extra: dict[str, Column] | None = None) -> Column:
    """Markdown text: frontmatter (title, source, url, published, tags, perspective,
    then any ``extra`` keys — e.g. the enrichment record) + body.

    Values are written in JSON syntax, which YAML reads back unchanged
    (strings stay strings, lists and mappings keep their shape)."""
    extra_lines = [F.concat(F.lit(f"{key}: "), json_value(value)) for key, value in (extra or {}).items()]
    fm = F.concat_ws("\n",
                     F.lit("---"),
                     F.concat(F.lit("title: "), json_scalar(title)),
                     F.concat(F.lit("source: "), json_scalar(source)),
                     F.concat(F.lit("url: "), json_scalar(url)),
                     F.concat(F.lit("published: "), json_scalar(published)),
                     F.concat(F.lit("tags: "), F.coalesce(F.to_json(tags), F.lit("[]"))),
                     F.concat(F.lit("perspective: "), json_scalar(F.coalesce(perspective, F.lit("")))),
                     *extra_lines,
                     F.lit("---"))
    return F.concat(fm, F.lit("\n\n"), F.coalesce(body, F.lit("")), F.lit("\n"))


def file_name(date: Column, stem: Column) -> Column:
    """``{date} - {stem}.md``, or ``{stem}.md`` without a date."""
    d = F.coalesce(date, F.lit(""))
    return F.when(d != "", F.concat(d, F.lit(" - "), stem, F.lit(".md"))).otherwise(F.concat(stem, F.lit(".md")))


def sink_documents(docs: DataFrame, path: str, mode: str = "append") -> str:
    """Append rendered documents as parquet partitioned by namespace."""
    docs.write.mode(mode).partitionBy("namespace").parquet(path)
    return path


def export_markdown(docs: DataFrame, root: str, dir_col: str = "namespace",
                    name_col: str = "file_name", text_col: str = "doc_text") -> None:
    """One file per row at ``root/<dir>/<file_name>``, committed together (see :mod:`tidepool.sources.filetree`)."""
    from tidepool.sources.filetree import write_files
    write_files(docs.select(F.col(dir_col).alias("dir"), F.col(name_col).alias("name"), F.col(text_col).alias("body")), root)


def sink_packets(packets: DataFrame, path: str) -> str:
    """JSON lines, UTF-8, non-ASCII unescaped; an empty frame writes no data file."""
    packets.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def sink_failed_queue(failed: DataFrame, path: str) -> str:
    """Append ``{path, errors}`` rows to the re-run queue."""
    failed.select("path", "errors").write.mode("append").json(path)
    return path


def sink_usage_log(usage: DataFrame, path: str) -> str:
    """Append token-usage rows ``{ts, model, token buckets}``."""
    usage.write.mode("append").json(path)
    return path


def sink_digest(lines: DataFrame, path: str) -> str:
    """The digest as one text file, lines in order (the frame is ≤ a few hundred rows)."""
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)
    return path
