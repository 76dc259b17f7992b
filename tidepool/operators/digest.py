"""Topic-grouped digest: window → verification → group → order → lines.

All heavy steps run on the index through :func:`window_query`; after the
top-k limit the frame holds at most ``limit`` entries (times their primary
topics), so the numbering windows here run on a few hundred rows.
``group_by_topic`` alone also runs on the whole index as a partial
aggregation (hot topics are combined map-side before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool import contracts as C
from tidepool.functions.text import md_escape, snippet
from tidepool.functions.urls import safe_link
from tidepool.operators.query import window_query


def topic_list(primary: Column) -> Column:
    """Primary topics, or ['(uncategorized)'] when there are none."""
    return F.when(F.coalesce(F.size(primary), F.lit(0)) > 0, primary).otherwise(F.array(F.lit(C.UNCATEGORIZED)))


def group_by_topic(index: DataFrame) -> DataFrame:
    """(topic, n_entries): an entry counts under every primary topic (repeats count twice)."""
    return (index.select(F.explode(topic_list(F.col("primary_topics"))).alias("topic"))
            .groupBy("topic").agg(F.count(F.lit(1)).alias("n_entries")))


def topic_order(groups: DataFrame) -> DataFrame:
    """Groups by size desc, then name asc, numbered 1.. (one row per topic).

    The input is already aggregated to one row per primary topic, and primary
    topics are validated against the controlled vocabulary, so the numbering
    window runs over at most |vocabulary| + 1 rows.
    """
    return groups.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("n_entries").desc(), F.col("topic").asc())))


def tier_label(tier: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in C.TIER_LABELS.items():
        expr = expr.when(tier == k, F.lit(v))
    return expr.otherwise(tier)


def digest_line(title: Column, url: Column, source: Column, published: Column, summary: Column,
                tier: Column | None = None) -> Column:
    """One bullet: link or bare title, optional tier, ' — ', source · published, snippet line."""
    t = F.coalesce(F.nullif(title, F.lit("")), F.lit(C.UNTITLED_ENTRY))
    u = F.coalesce(url, F.lit(""))
    snip = snippet(summary)
    safe = F.when(u != "", safe_link(u))
    link_part = F.when(safe.isNotNull(), F.concat(F.lit("["), md_escape(t), F.lit("](<"), safe, F.lit(">)"))) \
        .otherwise(md_escape(t))
    tier_part = F.lit("") if tier is None else \
        F.when(u != "", F.concat(F.lit(" · "), tier_label(F.coalesce(tier, F.lit("stale"))))).otherwise(F.lit(""))
    meta = F.concat_ws(" · ", F.nullif(source, F.lit("")), F.nullif(published, F.lit("")))
    tail = F.when(snip != "", F.concat(F.lit("\n  _"), snip, F.lit("_"))).otherwise(F.lit(""))
    return F.concat(F.lit("- "), link_part, tier_part, F.lit(" — "), meta, tail)


def date_range_label(since: str | None, until: str | None) -> str:
    if since and until:
        return f" · {since} – {until}"
    if since:
        return f" · since {since}"
    if until:
        return f" · until {until}"
    return ""


def digest_lines(entries: DataFrame, *, since: str | None, until: str | None,
                 run_date: str = C.RUN_DATE, with_tier: bool = False) -> DataFrame:
    """Render ranked entries (≤ limit rows) into numbered digest lines.

    Lines: header, generated line, blank; then per topic group (size desc,
    name asc) a '## topic' line, its bullets in window order, a blank line.
    Trailing blank lines are dropped and the last line right-stripped, as a
    final ``rstrip`` of the whole text would.
    """
    tier = F.col("tier") if with_tier else None
    ent = entries.withColumn("bullet", digest_line(F.col("title"), F.col("url"), F.col("source"),
                                                   F.col("published"), F.col("summary"), tier))
    n_entries = ent.agg(F.count(F.lit(1)).alias("n"))
    ex = ent.select("rank", "bullet", F.explode(topic_list(F.col("primary_topics"))).alias("topic"))
    ex = ex.withColumn("cnt", F.count(F.lit(1)).over(Window.partitionBy("topic")))
    ex = ex.withColumn("g", F.dense_rank().over(Window.orderBy(F.col("cnt").desc(), F.col("topic").asc())))
    header = n_entries.select(F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.lit(f"# Digest{date_range_label(since, until)}").alias("line")),
        F.struct(F.lit(1).alias("k"), F.concat(F.lit(f"_Generated {run_date} · "), F.col("n").cast("string"),
                                               F.lit(" entries_")).alias("line")),
        F.struct(F.lit(2).alias("k"), F.lit("").alias("line")))).alias("h")) \
        .select(F.lit(0).alias("g"), F.lit(0).alias("part"), F.col("h.k").cast("long").alias("k"), F.col("h.line").alias("line"))
    groups = ex.select("g", "topic").distinct()
    heads = groups.select("g", F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"),
                          F.concat(F.lit("## "), F.col("topic")).alias("line"))
    bullets = ex.select("g", F.lit(1).alias("part"), F.col("rank").cast("long").alias("k"), F.col("bullet").alias("line"))
    blanks = groups.select("g", F.lit(2).alias("part"), F.lit(0).cast("long").alias("k"), F.lit("").alias("line"))
    lines = header.unionByName(heads).unionByName(bullets).unionByName(blanks)
    lines = lines.withColumn("line_no", F.row_number().over(Window.orderBy("g", "part", "k")))
    last = F.max(F.when(F.col("line") != "", F.col("line_no"))).over(Window.partitionBy())
    out = lines.withColumn("last", last).where(F.col("line_no") <= F.col("last"))
    return out.select("line_no", F.when(F.col("line_no") == F.col("last"),
                                        F.regexp_replace("line", r"(?U)\s+$", "")).otherwise(F.col("line")).alias("line"))


def digest(index: DataFrame, *, since: str | None = None, until: str | None = None,
           limit: int = C.WINDOW_LIMIT, run_date: str = C.RUN_DATE,
           checks: DataFrame | None = None) -> DataFrame:
    """The digest as numbered lines; with ``checks`` (url, tier) links get tier labels."""
    # ≤ limit rows: freeze them once; the line builders below read them several times
    from tidepool.session import cut_lineage
    entries = cut_lineage(window_query(index, since=since, until=until, limit=limit))
    if checks is not None:
        from tidepool.operators.verify import verification_join
        entries = verification_join(entries, checks, entries_bound=limit)
    return digest_lines(entries, since=since, until=until, run_date=run_date, with_tier=checks is not None)


def digest_text(lines: DataFrame) -> DataFrame:
    """The whole digest as one string (after the limit: a few hundred lines)."""
    return lines.agg(F.concat(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY line_no)"),
                              F.lit("\n")).alias("digest"))
