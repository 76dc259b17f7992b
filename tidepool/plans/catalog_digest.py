"""Checked queries: index (J4), window query (J5), digest and link audit (J6/J7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import digest as D
from tidepool.operators import index as I
from tidepool.operators import query as Q
from tidepool.operators import verify as V
from tidepool.plans import fixtures as fx
from tidepool.plans import sqlfn as S
from tidepool.plans.catalog import register
from tidepool.functions.urls import IPV4_RE
from tidepool.plans.oracle_views import host_ips_sql, with_views

SINCE, UNTIL = "2024-01-05", "2024-01-25"


def _flat(df: DataFrame, *extra) -> DataFrame:
    return df.select("path", "title", "source", "url", "published",
                     F.array_join("primary_topics", "|").alias("primary_topics"),
                     F.array_join("secondary_topics", "|").alias("secondary_topics"), "summary", *extra)


def _ranked(df: DataFrame) -> DataFrame:
    return _flat(df, F.col("rank").cast("long").alias("rank"))


_FLAT_SQL = ("path, title, source, url, published, array_to_string(primary_topics, '|') AS primary_topics, "
             "array_to_string(secondary_topics, '|') AS secondary_topics, summary")
_ORDER_SQL = "coalesce(published, '') DESC, string_split(path, '/') ASC"


# --------------------------------------------------------------------------- J5
@register("window_query", with_views(f"""
SELECT {_FLAT_SQL}, rank FROM (
  SELECT *, row_number() OVER (ORDER BY {_ORDER_SQL}) AS rank FROM v_index
  WHERE coalesce(published, '') >= '{SINCE}' AND coalesce(published, '') <= '{UNTIL}')
WHERE rank <= 50""", "v_index"))
def q_window_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest 50 entries published between two dates, ranked."""
    w = Q.window_query(fx.v_index(spark, sf_dir), since=SINCE, until=UNTIL, limit=50)
    return _ranked(w)


@register("filter_date_range", with_views(f"""
SELECT {_FLAT_SQL} FROM v_index WHERE coalesce(published, '') <= '2024-01-10'""", "v_index"))
def q_filter_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only an upper bound: entries without a date pass it."""
    return _flat(Q.filter_date_range(fx.v_index(spark, sf_dir), until="2024-01-10"))


@register("filter_topic", with_views(f"""
SELECT {_FLAT_SQL} FROM v_index WHERE list_contains(primary_topics || secondary_topics, 'long')""", "v_index"))
def q_filter_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(Q.filter_topic(fx.v_index(spark, sf_dir), "long"))


@register("filter_source", with_views(f"""
SELECT {_FLAT_SQL} FROM v_index WHERE source = 'src3'""", "v_index"))
def q_filter_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(Q.filter_source(fx.v_index(spark, sf_dir), "src3"))


@register("all_topics", with_views("""
SELECT path, array_to_string(primary_topics || secondary_topics, '|') AS topics FROM v_index""", "v_index"))
def q_all_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = fx.v_index(spark, sf_dir)
    return idx.select("path", F.array_join(Q.all_topics(F.col("primary_topics"), F.col("secondary_topics")), "|")
                      .alias("topics"))


@register("window_query_topic_source", with_views(f"""
SELECT {_FLAT_SQL}, rank FROM (
  SELECT *, row_number() OVER (ORDER BY {_ORDER_SQL}) AS rank FROM v_index
  WHERE coalesce(published, '') >= '2024-01-03' AND list_contains(primary_topics || secondary_topics, 'en')
    AND source = 'src1')
WHERE rank <= 5""", "v_index"))
def q_window_topic_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Q.window_query(fx.v_index(spark, sf_dir), since="2024-01-03", topic="en", source="src1", limit=5)
    return _ranked(w)


# --------------------------------------------------------------------------- J4
@register("filter_enriched", with_views("""
SELECT path, source FROM v_docs WHERE enriched""", "v_docs"))
def q_filter_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.filter_enriched(fx.v_docs(spark, sf_dir)).select("path", "source")


@register("filter_backlog", with_views("""
SELECT path, source FROM v_docs WHERE NOT coalesce(enriched, false)""", "v_docs"))
def q_filter_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.filter_backlog(fx.v_docs(spark, sf_dir)).select("path", "source")


@register("backlog_cap", with_views("""
SELECT path, rank FROM (
  SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS rank
  FROM v_docs WHERE NOT coalesce(enriched, false)) WHERE rank <= 25""", "v_docs"))
def q_backlog_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.backlog_cap(fx.v_docs(spark, sf_dir), 25).select("path", "rank")


def _index_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched documents carrying index metadata (the V_index columns on V_docs)."""
    return fx.v_index(spark, sf_dir)


@register("index_entry", with_views("""
SELECT path, coalesce(nullif(title, ''), regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '')) AS title,
       coalesce(source, '') AS source, coalesce(url, '') AS url, coalesce(published, '') AS published,
       array_to_string(tags, '|') AS tags, array_to_string(primary_topics, '|') AS primary_topics,
       array_to_string(secondary_topics, '|') AS secondary_topics, coalesce(summary, '') AS summary, entities, true AS enriched
FROM v_index""", "v_index"))
def q_index_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.index_entry(_index_docs(spark, sf_dir))
    return e.select("path", "title", "source", "url", "published", F.array_join("tags", "|").alias("tags"),
                    F.array_join("primary_topics", "|").alias("primary_topics"),
                    F.array_join("secondary_topics", "|").alias("secondary_topics"), "summary", _entities_text(), "enriched")


def _entities_text():
    """The open entity map as one string, categories in order."""
    entries = F.array_sort(F.map_entries("entities"))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";").alias("entities")


@register("index_order", with_views(f"""
SELECT path, published, row_number() OVER (ORDER BY {_ORDER_SQL}) AS rank FROM v_index""", "v_index"))
def q_index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global index position of every entry (range-partitioned, no single-task sort)."""
    e = I.index_entry(_index_docs(spark, sf_dir))
    return I.index_order(e).select("path", "published", "rank")


@register("scan_index", with_views(f"""
SELECT {_FLAT_SQL}, CASE WHEN published SIMILAR TO '[0-9]{{4}}-[0-9]{{2}}.*' THEN substr(published, 1, 7)
       ELSE '0000-00' END AS month FROM v_index""", "v_index"))
def q_scan_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index written month-partitioned (sink_index) and read back (scan_index)."""
    from tidepool.session import scratch_path
    path = I.sink_index(I.index_entry(_index_docs(spark, sf_dir)), scratch_path(spark, "index"))
    idx = I.scan_index(spark, path)
    return _flat(idx, F.col("month").cast("string").alias("month"))


@register("window_query_stored", with_views(f"""
SELECT {_FLAT_SQL}, rank FROM (
  SELECT *, row_number() OVER (ORDER BY {_ORDER_SQL}) AS rank FROM v_index
  WHERE coalesce(published, '') >= '2024-01-20')
WHERE rank <= 50""", "v_index"))
def q_window_query_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window query over the stored index: month pruning + pushed-down bounds."""
    from tidepool.session import scratch_path
    path = I.sink_index(I.index_entry(_index_docs(spark, sf_dir)), scratch_path(spark, "index"))
    w = Q.window_query(I.scan_index(spark, path), since="2024-01-20", limit=50)
    return _ranked(w)


# --------------------------------------------------------------------------- J6
@register("group_by_topic", with_views("""
SELECT topic, CAST(count(*) AS BIGINT) AS n_entries FROM (
  SELECT unnest(CASE WHEN len(primary_topics) > 0 THEN primary_topics ELSE ['(uncategorized)'] END) AS topic
  FROM v_index) GROUP BY topic""", "v_index"))
def q_group_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.group_by_topic(fx.v_index(spark, sf_dir))


@register("topic_order", with_views("""
SELECT topic, n_entries, row_number() OVER (ORDER BY n_entries DESC, topic ASC) AS rank FROM (
  SELECT topic, CAST(count(*) AS BIGINT) AS n_entries FROM (
    SELECT unnest(CASE WHEN len(primary_topics) > 0 THEN primary_topics ELSE ['(uncategorized)'] END) AS topic
    FROM v_index) GROUP BY topic)""", "v_index"))
def q_topic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.topic_order(D.group_by_topic(fx.v_index(spark, sf_dir)))
    return t.withColumn("rank", F.col("rank").cast("long"))


@register("snippet", with_views(f"""
SELECT path, {S.snippet('summary')} AS snippet FROM v_index""", "v_index"))
def q_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.functions.text import snippet
    return fx.v_index(spark, sf_dir).select("path", snippet(F.col("summary")).alias("snippet"))


@register("digest_line", with_views(f"""
SELECT path, {S.digest_line('title', 'url', 'source', 'published', 'summary')} AS line FROM v_index""", "v_index"))
def q_digest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = fx.v_index(spark, sf_dir)
    return i.select("path", D.digest_line(F.col("title"), F.col("url"), F.col("source"), F.col("published"),
                                          F.col("summary")).alias("line"))


def _digest_sql(since: str | None, until: str | None, limit: int, tiers_cte: str | None = None) -> str:
    conds = []
    if since:
        conds.append(f"coalesce(published, '') >= '{since}'")
    if until:
        conds.append(f"coalesce(published, '') <= '{until}'")
    where = ("WHERE " + " AND ".join(conds)) if conds else ""
    label = D.date_range_label(since, until)
    tier = "tier" if tiers_cte else None
    join = "LEFT JOIN tiers t ON e.url = t.url" if tiers_cte else ""
    tier_expr = "CASE WHEN coalesce(e.url, '') <> '' THEN coalesce(t.tier, 'stale') END AS tier" \
        if tiers_cte else "NULL AS tier"
    return f"""
, ent AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER_SQL}) AS rank FROM v_index {where})
          WHERE rank <= {limit}),
ent2 AS (SELECT e.*, {tier_expr} FROM ent e {join}),
b AS (SELECT rank, {S.digest_line('title', 'url', 'source', 'published', 'summary', tier)} AS bullet,
             unnest(CASE WHEN len(primary_topics) > 0 THEN primary_topics ELSE ['(uncategorized)'] END) AS topic
      FROM ent2),
g AS (SELECT topic, dense_rank() OVER (ORDER BY cnt DESC, topic ASC) AS g FROM
        (SELECT topic, count(*) AS cnt FROM b GROUP BY topic)),
lines AS (
  SELECT 0 AS g, 0 AS part, 0 AS k, '# Digest{label}' AS line
  UNION ALL SELECT 0, 0, 1, '_Generated 2024-02-01 · ' || CAST((SELECT count(*) FROM ent) AS VARCHAR) || ' entries_'
  UNION ALL SELECT 0, 0, 2, ''
  UNION ALL SELECT g, 0, 0, '## ' || topic FROM g
  UNION ALL SELECT g.g, 1, b.rank, b.bullet FROM b JOIN g USING (topic)
  UNION ALL SELECT g, 2, 0, '' FROM g),
numbered AS (SELECT row_number() OVER (ORDER BY g, part, k) AS line_no, line FROM lines),
last AS (SELECT max(line_no) AS last FROM numbered WHERE line <> '')
SELECT line_no, CASE WHEN line_no = last THEN regexp_replace(line, '\\s+$', '') ELSE line END AS line
FROM numbered, last WHERE line_no <= last"""


def _digest_query_sql(since, until, limit, tiers_cte=None, views=("v_index",), extra=None):
    body = _digest_sql(since, until, limit, tiers_cte)
    extra = dict(extra or {})
    if tiers_cte:
        extra["tiers"] = tiers_cte
    sql = with_views("SELECT 1", *views, extra=extra or None)
    head = sql[: sql.rindex("\nSELECT 1")]
    return head + body


@register("digest", _digest_query_sql("2024-01-10", None, 50))
def q_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic-grouped digest lines for the newest 50 entries since a date."""
    lines = D.digest(fx.v_index(spark, sf_dir), since="2024-01-10", limit=50)
    return lines.select(F.col("line_no").cast("long").alias("line_no"), "line")


# --------------------------------------------------------------------------- J7
def _doc_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HEAD results for document links: status from the fetch-log row with the same id;
    links whose fetch errored have no check row."""
    items = fx.v_items(spark, sf_dir).select("doc_id", F.col("link").alias("url"))
    ev = fx.v_checks(spark, sf_dir).select(F.col("event_id").alias("doc_id"), "status")
    return items.join(ev, "doc_id").where(F.col("status").isNotNull() & (F.col("url") != "")).select("url", "status")


_DOC_CHECKS_SQL = """
SELECT i.link AS url, c.status FROM v_items i JOIN v_checks c ON c.event_id = i.doc_id
WHERE c.status IS NOT NULL AND i.link <> ''"""


def _hosts_dns(spark: SparkSession, urls: DataFrame) -> DataFrame:
    from tidepool.functions.urls import hostname
    hosts = urls.select(hostname(F.col("url")).alias("host")).distinct()
    return fx.host_ips_for(hosts)


def _guard_sql(src: str) -> str:
    """SQL of url_guard over relation ``src`` (has ``url``) with host table ``dns``."""
    return f"""
SELECT s.*,
  CASE WHEN s.scheme NOT IN ('http', 'https') THEN 'scheme'
       WHEN s.host = '' THEN 'empty_host'
       WHEN s.host IN ('metadata.google.internal', '169.254.169.254') THEN 'metadata_host'
       WHEN regexp_matches(s.host, '{IPV4_RE}') THEN CASE WHEN {S.ipv4_blocked('s.host')} THEN 'private_ip' END
       WHEN r.n_ips IS NULL OR r.n_ips = 0 THEN 'unresolved'
       WHEN r.any_blocked THEN 'private_ip' END AS guard_reason
FROM (SELECT *, {S.url_host('url')} AS host, {S.url_scheme('url')} AS scheme FROM {src}) s
LEFT JOIN (SELECT lower(host) AS host, count(ip) AS n_ips, bool_or({S.ipv4_blocked('ip')}) AS any_blocked
           FROM dns GROUP BY lower(host)) r ON r.host = s.host"""


def _dns_cte(src: str) -> str:
    return host_ips_sql(f"SELECT DISTINCT {S.url_host('url')} AS host FROM {src}")


_TIER_SQL = """CASE WHEN guard_reason IS NOT NULL THEN 'blocked' WHEN status IN (404, 410) THEN 'dead'
       WHEN status >= 200 AND status < 400 THEN 'live' ELSE 'stale' END"""


@register("status_tier", with_views(f"""
SELECT url, CAST(status AS BIGINT) AS status, {_TIER_SQL} AS tier, guard_reason FROM g""", "v_checks",
    extra={"dns": _dns_cte("v_checks"), "g": _guard_sql("v_checks")}))
def q_status_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = fx.v_checks(spark, sf_dir)
    t = V.check_tiers(checks, _hosts_dns(spark, checks))
    return t.select("url", F.col("status").cast("long").alias("status"), "tier", "guard_reason")


@register("verification_join", with_views(f"""
SELECT i.path, i.url, CASE WHEN i.url <> '' THEN coalesce(t.tier, 'stale') END AS tier
FROM v_index i LEFT JOIN (SELECT url, {_TIER_SQL} AS tier FROM g) t ON i.url = t.url""", "v_index", "v_checks",
    extra={"doc_checks": _DOC_CHECKS_SQL, "dns": _dns_cte("doc_checks"), "g": _guard_sql("doc_checks")}))
def q_verification_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _doc_checks(spark, sf_dir)
    tiers = V.check_tiers(checks, _hosts_dns(spark, checks))
    e = V.verification_join(fx.v_index(spark, sf_dir), tiers)
    return e.select("path", "url", "tier")


@register("digest_verified", _digest_query_sql(
    "2024-01-10", None, 50, tiers_cte=f"SELECT url, {_TIER_SQL} AS tier FROM guarded",
    views=("v_index", "v_items", "v_checks"),
    extra={"doc_checks": _DOC_CHECKS_SQL, "dns": _dns_cte("doc_checks"), "guarded": _guard_sql("doc_checks")}))
def q_digest_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _doc_checks(spark, sf_dir)
    tiers = V.check_tiers(checks, _hosts_dns(spark, checks))
    lines = D.digest(fx.v_index(spark, sf_dir), since="2024-01-10", limit=50, checks=tiers)
    return lines.select(F.col("line_no").cast("long").alias("line_no"), "line")


@register("url_guard", with_views("""
SELECT page_id, host, guard_reason IS NOT NULL AS blocked, guard_reason FROM g""",
    extra={"pages_u": "SELECT page_id, url FROM pages", "dns": _dns_cte("pages_u"), "g": _guard_sql("pages_u")}))
def q_url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.v_pages(spark, sf_dir).select("page_id", "url")
    g = V.url_guard(pages, _hosts_dns(spark, pages))
    return g.select("page_id", "host", "blocked", "guard_reason")


@register("distinct_urls", with_views("""
SELECT link AS url, min(pos) AS first_pos FROM v_dedup WHERE link <> '' GROUP BY link""", "v_dedup"))
def q_distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.v_dedup(spark, sf_dir).select(F.col("link").alias("url"), "pos")
    return V.distinct_urls(d, "pos")


def _sink_digest_sql() -> str:
    inner = _digest_query_sql("2024-01-10", None, 50)
    return f"SELECT string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS digest FROM ({inner})"


@register("sink_digest", _sink_digest_sql())
def q_sink_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest written as one markdown text file and read back line by line."""
    from tidepool.session import scratch_path
    from tidepool.sources.sinks import sink_digest
    lines = D.digest(fx.v_index(spark, sf_dir), since="2024-01-10", limit=50)
    path = sink_digest(lines, scratch_path(spark, "digest"))
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("digest"))


@register("sink_index", with_views("""
SELECT CASE WHEN regexp_matches(published, '^[0-9]{4}-[0-9]{2}') THEN substr(published, 1, 7) ELSE '0000-00' END
         AS month, CAST(count(*) AS BIGINT) AS entries
FROM v_index GROUP BY 1""", "v_index"))
def q_sink_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index written month-partitioned; entries per partition as stored."""
    from tidepool.session import scratch_path
    path = I.sink_index(I.index_entry(_index_docs(spark, sf_dir)), scratch_path(spark, "index"))
    return I.scan_index(spark, path).groupBy(F.col("month").cast("string").alias("month")) \
        .agg(F.count(F.lit(1)).cast("long").alias("entries"))


@register("index_from_markdown", with_views("""
SELECT path, title, source, coalesce(url, '') AS url, coalesce(published, '') AS published,
       array_to_string(tags, '|') AS tags, array_to_string(primary_topics, '|') AS primary_topics,
       array_to_string(secondary_topics, '|') AS secondary_topics, coalesce(summary, '') AS summary, entities, true AS enriched
FROM v_index""", "v_index"))
def q_index_from_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched documents written as Markdown (frontmatter with the record), scanned
    back from the folder tree and projected to index entries."""
    from tidepool.session import scratch_path
    from tidepool.sources.scans import scan_documents
    from tidepool.sources.sinks import export_markdown, render_document
    idx = fx.v_index(spark, sf_dir)
    record = {"enriched": F.col("enriched"), "summary": F.col("summary"),
              "topics": F.struct(F.col("primary_topics").alias("primary"), F.col("secondary_topics").alias("secondary")),
              "entities": F.struct(F.col("entities")["organizations"].alias("organizations"), F.array().cast("array<string>").alias("people"),
                                   F.col("entities")["venues"].alias("venues")),
              "reviewed_by": F.lit("nobody")}
    files = idx.select(F.col("source").alias("namespace"),
                       F.element_at(F.split("path", "/"), -1).alias("file_name"),
                       render_document(F.col("title"), F.col("source"), F.col("url"), F.col("published"),
                                       F.col("tags"), F.lit(""), F.lit("body"), extra=record).alias("doc_text"))
    root = scratch_path(spark, "content-enriched")
    export_markdown(files, root)
    docs, _bad = scan_documents(spark, root)
    e = I.index_from_documents(I.documents_from_markdown(docs))
    return e.select("path", "title", "source", "url", "published", F.array_join("tags", "|").alias("tags"),
                    F.array_join("primary_topics", "|").alias("primary_topics"),
                    F.array_join("secondary_topics", "|").alias("secondary_topics"), "summary", _entities_text(), "enriched")
