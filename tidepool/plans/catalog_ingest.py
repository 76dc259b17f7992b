"""Checked queries: scans and the ingest job (J1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import dates as Dt
from tidepool.operators import ingest as G
from tidepool.plans import fixtures as fx
from tidepool.plans import sqlfn as S
from tidepool.plans.catalog import register
from tidepool.plans.oracle_views import with_views
from tidepool.sources import scans as SC

NL = "chr(10)"

# ---------------------------------------------------------------------------
# Feed entries
# ---------------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed feed entries; a source's feed order is (document, entry position)."""
    e = SC.scan_feed(fx.v_feed(spark, sf_dir))
    return e.withColumn("pos", F.col("doc_id") * 1000 + F.col("pos"))


_UTC_DATE_SQL = ("strftime(CAST(published || ' ' || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || ':30:00' AS TIMESTAMP)"
                 " + to_hours(CASE doc_id % 4 WHEN 1 THEN 5 WHEN 2 THEN -9 ELSE 0 END), '%Y-%m-%d')")

_READABLE = "doc_id % 50 NOT IN (7, 8)"

_ENTRIES_SQL = f"""
SELECT doc_id, source, doc_id * 1000 AS pos, {S.strip_html('title')} AS title, link,
       {S.strip_html('description')} AS description, {S.strip_html('description')} AS content,
       guid AS entry_id, {_UTC_DATE_SQL} AS date
FROM v_items WHERE {_READABLE}
UNION ALL
SELECT doc_id, source, doc_id * 1000 + 1, {S.strip_html("'Second ' || title")}, CASE WHEN link = '' THEN '' ELSE link || '/2' END,
       {S.strip_html('title')}, {S.strip_html('title')}, CASE WHEN guid = '' THEN '' ELSE guid || '/2' END, {_UTC_DATE_SQL}
FROM v_items WHERE {_READABLE} AND doc_id % 3 = 0"""


@register("scan_feed", with_views("""
SELECT doc_id, source, pos, title, link, description, content, entry_id, date FROM entries""", "v_items",
    extra={"entries": _ENTRIES_SQL}))
def q_scan_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS 2.0 and Atom documents parsed into one entry shape."""
    return _entries(spark, sf_dir).select("doc_id", "source", "pos", "title", "link", "description", "content",
                                          "entry_id", "date")


@register("feed_quarantine", with_views("""
SELECT doc_id, source, CASE WHEN doc_id % 50 = 7 THEN 'not_a_feed' ELSE 'unreadable' END AS reason
FROM v_items WHERE doc_id % 50 IN (7, 8)""", "v_items"))
def q_feed_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds that cannot be read, with the reason; the others are in scan_feed."""
    return SC.feed_quarantine(fx.v_feed(spark, sf_dir)).select("doc_id", "source", "reason")


@register("parse_pub_date", with_views("""
SELECT doc_id, date FROM entries""", "v_items", extra={"entries": _ENTRIES_SQL}))
def q_parse_pub_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFC 2822 (with offsets and GMT) and ISO 8601 feed dates → UTC day."""
    raw = SC.scan_feed(fx.v_feed(spark, sf_dir))
    return raw.select("doc_id", Dt.parse_pub_date(F.col("pub_raw")).alias("date"))


_FREE_DATES_SQL = """
SELECT pos, CASE pos % 10 WHEN 9 THEN NULL WHEN 6 THEN strftime(CAST(published AS DATE) + 1, '%Y-%m-%d') ELSE published END AS date, pos % 10 <> 9 AS known FROM v_items"""


@register("parse_pub_date_free", with_views(_FREE_DATES_SQL, "v_items"))
def q_parse_pub_date_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's date written in one of ten free forms (one of them no date) → UTC day, and whether one was found."""
    day = F.to_date("published")
    th = F.when(F.day(day).isin(1, 21, 31), "st").when(F.day(day).isin(2, 22), "nd").when(F.day(day).isin(3, 23), "rd").otherwise("th")
    forms = ("yyyy", "MMMM d", "EEEE d", "MMM. d, yyyy 'at' h:mm a", "yyyy MMMM dd", "dd.MM.yyyy", "MMMM d yyyy '11:30pm EST'", "d-MMM-yy", "yyyyMMdd")
    made = [F.date_format(F.to_timestamp(day), f) for f in forms]
    texts = [F.concat(made[1], th, F.lit(", "), F.year(day)), F.concat(made[2], th, F.lit(" of "), F.date_format(day, "MMMM yyyy")), made[3], made[4],
             F.concat(F.date_format(day, "yyyy/MM/dd"), F.lit(" 07:15:00 +0100")), F.concat(F.date_format(day, "d MMM"), F.lit(", "), F.year(day), F.lit(" 10 a.m. UTC")),
             made[6], F.concat(F.lit("on "), made[7]), made[8], F.lit("some time soon")]
    items = fx.v_items(spark, sf_dir)
    text = F.element_at(F.array(*texts), (F.col("pos") % 10 + 1).cast("int"))
    found = items.select("pos", Dt.pub_date(text).alias("date"))
    return found.select("pos", "date", F.col("date").isNotNull().alias("known"))


# ---------------------------------------------------------------------------
# Registry, limit, keyword filter
# ---------------------------------------------------------------------------

_JOIN_SQL = """
SELECT e.*, r.source_ord, r.tags, coalesce(r.perspective, '') AS perspective, r.scrape_limit,
       r.scrape_full_content, r.kf_mode, r.kf_include, r.output_dir AS namespace
FROM entries e JOIN v_registry r ON e.source = r.name WHERE r.enabled"""


@register("join_registry", with_views("""
SELECT source, pos, array_to_string(tags, '|') AS tags, perspective, CAST(scrape_limit AS BIGINT) AS scrape_limit,
       kf_mode, array_to_string(kf_include, '|') AS kf_include FROM j""", "v_items", "v_registry",
    extra={"entries": _ENTRIES_SQL, "j": _JOIN_SQL}))
def q_join_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = G.join_registry(_entries(spark, sf_dir), fx.v_registry(spark, sf_dir))
    return j.select("source", "pos", F.array_join("tags", "|").alias("tags"), "perspective",
                    F.col("scrape_limit").cast("long").alias("scrape_limit"), "kf_mode",
                    F.array_join("kf_include", "|").alias("kf_include"))


_LIMIT_SQL = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn FROM j)
WHERE rn <= scrape_limit"""


@register("limit_per_source", with_views("""
SELECT source, pos FROM lim""", "v_items", "v_registry",
    extra={"entries": _ENTRIES_SQL, "j": _JOIN_SQL, "lim": _LIMIT_SQL}))
def q_limit_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = fx.v_registry(spark, sf_dir)
    j = G.join_registry(_entries(spark, sf_dir), reg)
    return G.limit_per_source(j, max_limit=G.registry_max_limit(reg)).select("source", "pos")


@register("keyword_filter", with_views(f"""
SELECT source, pos FROM j WHERE {S.keyword_match("title || ' ' || description", 'kf_mode', 'kf_include')}""",
    "v_items", "v_registry", extra={"entries": _ENTRIES_SQL, "j": _JOIN_SQL}))
def q_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive substring any/all on title + ' ' + description (every entry, no limit)."""
    j = G.join_registry(_entries(spark, sf_dir), fx.v_registry(spark, sf_dir))
    return G.keyword_filter(j, G.feed_filter_text()).select("source", "pos")


# ---------------------------------------------------------------------------
# Dedup: key, first wins, seen files
# ---------------------------------------------------------------------------

def _dedup_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.v_dedup(spark, sf_dir)
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return v.select("pos", "source", n.alias("source_ord"), "namespace", "title", "link",
                    F.col("guid").alias("entry_id"), "description")


_KEYED_SQL = f"""
SELECT *, {S.sanitize_title('title')} || '-' || {S.url_hash('dedup_id')} AS stem FROM (
  SELECT pos, source, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS source_ord, namespace, title,
         link, guid AS entry_id, description,
         coalesce(nullif(link, ''), nullif(guid, ''), title || {NL} || description) AS dedup_id
  FROM v_dedup)"""


@register("dedup_key", with_views("""
SELECT pos, dedup_id, stem FROM keyed""", "v_dedup", extra={"keyed": _KEYED_SQL}))
def q_dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dedup_key(_dedup_items(spark, sf_dir)).select("pos", "dedup_id", "stem")


_FIRSTS_SQL = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, stem ORDER BY source_ord, pos) AS rk
FROM keyed) WHERE rk = 1"""


@register("first_wins_dedup", with_views("""
SELECT namespace, stem, pos FROM firsts""", "v_dedup", extra={"keyed": _KEYED_SQL, "firsts": _FIRSTS_SQL}))
def q_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first_wins_dedup(G.dedup_key(_dedup_items(spark, sf_dir))).select("namespace", "stem", "pos")


_SEEN_STEM_SQL = "regexp_replace(regexp_replace(file_name, '\\.md$', ''), '^[0-9]{4}-[0-9]{2}-[0-9]{2} - ', '')"


@register("anti_join_seen", with_views(f"""
SELECT namespace, stem, pos FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM v_seen s WHERE s.namespace = f.namespace AND {_SEEN_STEM_SQL} = f.stem)""",
    "v_dedup", "v_seen", extra={"keyed": _KEYED_SQL, "firsts": _FIRSTS_SQL}))
def q_anti_join_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose (namespace, stem) already exists under any date are dropped."""
    firsts = G.first_wins_dedup(G.dedup_key(_dedup_items(spark, sf_dir)))
    return G.anti_join_seen(firsts, fx.v_seen(spark, sf_dir)).select("namespace", "stem", "pos")


@register("strip_date_prefix", with_views(f"""
SELECT namespace, file_name, {_SEEN_STEM_SQL} AS stem FROM v_seen""", "v_seen"))
def q_strip_date_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.v_seen(spark, sf_dir)
    return s.select("namespace", "file_name", Dt.file_stem(F.col("file_name")).alias("stem"))


# ---------------------------------------------------------------------------
# Bodies and the whole feed job
# ---------------------------------------------------------------------------

def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched article bodies keyed by the entry link (the article view of the same
    item — one projection of each document row, no join)."""
    a = fx.v_article(spark, sf_dir)
    return a.where(F.col("link") != "").select(F.col("link").alias("url"), "body")


_FETCHED_SQL = """SELECT i.link AS url, a.body FROM v_items i JOIN v_article a ON a.doc_id = i.doc_id
WHERE i.link <> ''"""


@register("full_body_join", with_views(f"""
SELECT j.source, j.pos,
       CASE WHEN coalesce(j.scrape_full_content, false) AND j.link <> '' AND f.body IS NOT NULL
                 AND {S.words('f.body')} >= 100 THEN 'fetched' ELSE 'excerpt' END AS content_from
FROM j LEFT JOIN fetched f ON f.url = j.link""", "v_items", "v_registry", "v_article",
    extra={"entries": _ENTRIES_SQL, "j": _JOIN_SQL, "fetched": _FETCHED_SQL}))
def q_full_body_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = G.join_registry(_entries(spark, sf_dir), fx.v_registry(spark, sf_dir))
    return G.full_body_join(j, _fetched(spark, sf_dir)).select("source", "pos", "content_from")


def _doc_text_sql(title, source, url, date, tags, perspective, body) -> str:
    parts = [f"'title: ' || to_json({title})", f"'source: ' || to_json({source})", f"'url: ' || to_json({url})",
             f"'published: ' || to_json({date})", f"'tags: ' || coalesce(to_json({tags}), '[]')",
             f"'perspective: ' || to_json(coalesce({perspective}, ''))"]
    fm = f" || {NL} || ".join(["'---'"] + parts + ["'---'"])
    return f"({fm} || {NL} || {NL} || coalesce({body}, '') || {NL})"


_INGEST_SQL = f"""
, lim AS ({_LIMIT_SQL}),
flt AS (SELECT * FROM lim WHERE {S.keyword_match("title || ' ' || description", 'kf_mode', 'kf_include')}),
keyed AS (SELECT *, {S.sanitize_title('title')} || '-' || {S.url_hash('dedup_id')} AS stem FROM (
   SELECT *, coalesce(nullif(link, ''), nullif(entry_id, ''), title || {NL} || description) AS dedup_id FROM flt)),
firsts AS ({_FIRSTS_SQL}),
new AS (SELECT * FROM firsts f WHERE NOT EXISTS (
   SELECT 1 FROM v_seen s WHERE s.namespace = f.namespace AND {_SEEN_STEM_SQL} = f.stem)),
bodies AS (SELECT n.*, CASE WHEN coalesce(n.scrape_full_content, false) AND n.link <> '' AND f.body IS NOT NULL
                          AND {S.words('f.body')} >= 100 THEN true ELSE false END AS use_fetched, f.body AS fbody
           FROM new n LEFT JOIN fetched f ON f.url = n.link)
SELECT namespace, CASE WHEN date <> '' THEN date || ' - ' || stem || '.md' ELSE stem || '.md' END AS file_name,
       source, link AS url, date, CASE WHEN use_fetched THEN 'fetched' ELSE 'excerpt' END AS content_from,
       {_doc_text_sql('title', 'source', 'link', 'date', 'tags', 'perspective',
                      'CASE WHEN use_fetched THEN fbody ELSE content END')} AS doc_text
FROM bodies"""


def _ingest_sql() -> str:
    head = with_views("SELECT 1", "v_items", "v_registry", "v_article", "v_seen", "v_dedup",
                      extra={"entries": _ENTRIES_SQL, "j": _JOIN_SQL + " AND r.type = 'rss'", "fetched": _FETCHED_SQL})
    return head[: head.rindex("\nSELECT 1")] + _INGEST_SQL


def ingest_feed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = SC.scan_feed_raw(fx.v_feed(spark, sf_dir)).withColumn("pos", F.col("doc_id") * 1000 + F.col("pos"))
    return G.ingest_feed_items(raw, fx.v_registry(spark, sf_dir), fx.v_seen(spark, sf_dir), _fetched(spark, sf_dir))


@register("ingest_feed", _ingest_sql())
def q_ingest_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feed adapter: new documents with their file names and rendered text."""
    d = ingest_feed_docs(spark, sf_dir)
    return d.select("namespace", "file_name", "source", F.col("link").alias("url"), "date", "content_from", "doc_text")


@register("scrape_counts", with_views("""
SELECT coalesce(source, 'TOTAL') AS source, CAST(count(*) AS BIGINT) AS new_documents
FROM docs GROUP BY ROLLUP (source)""", extra={"docs": "SELECT source FROM (" + _ingest_sql() + ")"}))
def q_scrape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New documents per source plus a TOTAL row (rollup)."""
    from tidepool.operators.audit import scrape_counts
    return scrape_counts(ingest_feed_docs(spark, sf_dir))


# ---------------------------------------------------------------------------
# Transcripts and the video adapter
# ---------------------------------------------------------------------------

_BEST_SQL = """
SELECT video, arg_min(track, prio * 1000000000 + first) AS track FROM (
  SELECT video, track, min(seq) AS first,
         CASE track WHEN 'manual_en' THEN 0 WHEN 'generated_en' THEN 1 ELSE 2 END AS prio
  FROM v_conv GROUP BY video, track) GROUP BY video"""

_TRANSCRIPT_SQL = f"""
SELECT c.video, string_agg({S.py_strip("coalesce(c.segment, '')")}, ' ' ORDER BY c.seq) AS transcript
FROM v_conv c JOIN best b ON b.video = c.video AND b.track = c.track GROUP BY c.video"""


@register("best_track", with_views("SELECT video, track FROM best", "v_conv", extra={"best": _BEST_SQL}))
def q_best_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual English track, else generated English, else the first other track."""
    from tidepool.operators.transcripts import best_track
    return best_track(fx.v_conv(spark, sf_dir))


@register("transcript_concat", with_views(f"""
SELECT video, string_agg({S.py_strip("coalesce(segment, '')")}, ' ' ORDER BY seq) AS transcript
FROM v_conv GROUP BY video""", "v_conv"))
def q_transcript_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments of a video, stripped and joined by one space in order (two-level)."""
    from tidepool.operators.transcripts import transcript_concat
    return transcript_concat(fx.v_conv(spark, sf_dir))


@register("filter_empty_transcript", with_views("""
SELECT video, transcript FROM tr WHERE regexp_matches(transcript, '\\S')""", "v_conv",
    extra={"best": _BEST_SQL, "tr": _TRANSCRIPT_SQL}))
def q_filter_empty_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferred-track transcripts with at least one non-blank character."""
    from tidepool.operators.transcripts import video_transcripts
    return video_transcripts(fx.v_conv(spark, sf_dir))


def _video_lines_sql() -> str:
    from tidepool.plans.catalog_text import _listing_lines_sql
    base = _listing_lines_sql()
    return base.replace("SELECT turn * 10000000000 + conv_id AS line_no,", "SELECT turn * 10000000000 + conv_id AS line_no, 'src' || CAST(conv_id % 20 AS VARCHAR) AS source,", 1)


def _video_caps_sql() -> str:
    from tidepool.plans.catalog_text import _CAPTIONS_SQL
    return _CAPTIONS_SQL.replace("SELECT line_no, id,", "SELECT line_no, source, id,", 1).replace(
        "FROM (SELECT line_no, json_extract_string", "FROM (SELECT line_no, source, json_extract_string", 1)


_VIDEO_SQL = f"""
, vj AS (SELECT c.*, r.source_ord, r.tags, coalesce(r.perspective, '') AS perspective, r.scrape_limit,
                r.kf_mode, r.kf_include, r.output_dir AS namespace
         FROM caps c JOIN v_registry r ON r.name = c.source WHERE r.enabled AND r.type = 'youtube'),
vl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_no) AS rn FROM vj)
       WHERE rn <= scrape_limit),
vt AS (SELECT vl.*, t.transcript AS content FROM vl JOIN tr t ON 'v' || CAST(t.video AS VARCHAR) = vl.id
       WHERE regexp_matches(t.transcript, '\\S')),
vf AS (SELECT * FROM vt WHERE {S.keyword_match("title || ' ' || content", 'kf_mode', 'kf_include')}),
keyed AS (SELECT *, {S.sanitize_title('title')} || '-' || {S.url_hash('url')} AS stem, line_no AS pos FROM vf),
firsts AS ({_FIRSTS_SQL}),
new AS (SELECT * FROM firsts f WHERE NOT EXISTS (
   SELECT 1 FROM v_seen s WHERE s.namespace = f.namespace AND {_SEEN_STEM_SQL} = f.stem))
SELECT namespace, CASE WHEN upload_date <> '' THEN upload_date || ' - ' || stem || '.md' ELSE stem || '.md' END
         AS file_name, source, url, upload_date AS date,
       {_doc_text_sql('title', 'source', 'url', 'upload_date', 'tags', 'perspective', 'content')} AS doc_text
FROM new"""


def _video_ingest_sql() -> str:
    head = with_views("SELECT 1", "v_conv", "v_registry", "v_seen", "v_dedup",
                      extra={"lines": _video_lines_sql(), "caps": _video_caps_sql(), "best": _BEST_SQL,
                             "tr": _TRANSCRIPT_SQL})
    return head[: head.rindex("\nSELECT 1")] + _VIDEO_SQL


def ingest_video_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ingest_video_items(fx.v_video_listing(spark, sf_dir), fx.v_conv(spark, sf_dir),
                                fx.v_registry(spark, sf_dir), fx.v_seen(spark, sf_dir))


@register("ingest_video", _video_ingest_sql())
def q_ingest_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video adapter: listing → per-source limit → preferred-track transcript → filter → dedup."""
    d = ingest_video_docs(spark, sf_dir)
    return d.select("namespace", "file_name", "source", "url", "date", "doc_text")


# ---------------------------------------------------------------------------
# The listing adapter
# ---------------------------------------------------------------------------

def _listing_sql_parts():
    from tidepool import contracts as C
    from tidepool.plans.catalog_text import _distinct_ordered_sql, _title_from_body_sql
    pat = C.DEFAULT_LISTING_LINK_PATTERN.replace("'", "''")
    links = _distinct_ordered_sql(f"regexp_extract_all(html, '{pat}', 1)")
    slug = "regexp_replace(string_split(regexp_replace(link, '/+$', ''), '/')[-1], '[-_]', ' ', 'g')"
    kw1 = S.keyword_match(slug, "kf_mode", "kf_include")
    kw2 = S.keyword_match("title || ' ' || substr(content, 1, 1000)", "kf_mode", "kf_include")
    date = ("coalesce(nullif(regexp_extract(substr(content, 1, 500), '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), ''), "
            "'2024-02-01')")
    return f"""
, pj AS (SELECT p.page_id, p.source, p.feed_url, p.html, r.source_ord, r.tags, coalesce(r.perspective, '') AS perspective,
                r.scrape_limit, r.kf_mode, r.kf_include, r.output_dir AS namespace
         FROM v_listing p JOIN v_registry r ON r.name = p.source WHERE r.enabled AND r.type = 'listing'),
pa AS (SELECT * EXCLUDE (ls), generate_subscripts(ls, 1) - 1 AS link_pos, unnest(ls) AS link
       FROM (SELECT * EXCLUDE (html), {links} AS ls FROM pj)),
pd AS (SELECT * FROM pa QUALIFY row_number() OVER (PARTITION BY source, link ORDER BY page_id, link_pos) = 1),
pl AS (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY source ORDER BY page_id, link_pos) <= scrape_limit),
pu AS (SELECT *, regexp_extract(feed_url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || link AS url FROM pl),
p1 AS (SELECT * FROM pu WHERE {kw1}),
pb AS (SELECT p1.*, a.body AS content FROM p1 JOIN v_article a ON a.url = p1.url WHERE {S.words('a.body')} >= 100),
pt AS (SELECT *, {_title_from_body_sql('content', 'url')} AS title, {date} AS date FROM pb),
p2 AS (SELECT * FROM pt WHERE {kw2}),
keyed AS (SELECT *, {S.sanitize_title('title')} || '-' || {S.url_hash('url')} AS stem,
                 (page_id, link_pos) AS pos FROM p2),
firsts AS ({_FIRSTS_SQL}),
new AS (SELECT * FROM firsts f WHERE NOT EXISTS (
   SELECT 1 FROM v_seen s WHERE s.namespace = f.namespace AND {_SEEN_STEM_SQL} = f.stem))
SELECT namespace, CASE WHEN date <> '' THEN date || ' - ' || stem || '.md' ELSE stem || '.md' END AS file_name,
       source, url, date, {_doc_text_sql('title', 'source', 'url', 'date', 'tags', 'perspective', 'content')} AS doc_text
FROM new"""


def _listing_ingest_sql() -> str:
    head = with_views("SELECT 1", "v_listing", "v_registry", "v_article", "v_seen", "v_dedup")
    return head[: head.rindex("\nSELECT 1")] + _listing_sql_parts()


def ingest_listing_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = fx.v_article(spark, sf_dir).select("url", "body")
    return G.ingest_listing_items(fx.v_listing(spark, sf_dir), fx.v_registry(spark, sf_dir),
                                  fx.v_seen(spark, sf_dir), fetched)


@register("ingest_listing", _listing_ingest_sql())
def q_ingest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing adapter: links → limit → slug filter → article body → title/date → filter → dedup."""
    d = ingest_listing_docs(spark, sf_dir)
    return d.select("namespace", "file_name", "source", "url", "date", "doc_text")


@register("keyword_filter_targets", "SELECT 'feed' AS dialect, namespace, file_name, doc_text FROM (" + _ingest_sql() +
          ") UNION ALL SELECT 'video', namespace, file_name, doc_text FROM (" + _video_ingest_sql() +
          ") UNION ALL SELECT 'listing', namespace, file_name, doc_text FROM (" + _listing_ingest_sql() + ")")
def q_keyword_filter_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which text each dialect filters on: feed title+description, video title+transcript,
    listing slug then title + first 1000 chars; the new documents that pass, whole."""
    cols = ("namespace", "file_name", "doc_text")
    f = ingest_feed_docs(spark, sf_dir).select(F.lit("feed").alias("dialect"), *cols)
    v = ingest_video_docs(spark, sf_dir).select(F.lit("video").alias("dialect"), *cols)
    li = ingest_listing_docs(spark, sf_dir).select(F.lit("listing").alias("dialect"), *cols)
    return G.union_adapters(f, v, li)


def _union_sql() -> str:
    each = (f"SELECT 'feed' AS dialect, 0 AS k, namespace, file_name, url, source FROM ({_ingest_sql()}) "
            f"UNION ALL SELECT 'video', 1, namespace, file_name, url, source FROM ({_video_ingest_sql()}) "
            f"UNION ALL SELECT 'listing', 2, namespace, file_name, url, source FROM ({_listing_ingest_sql()})")
    return (f"SELECT dialect, namespace, file_name, url FROM ({each}) QUALIFY row_number() OVER (PARTITION BY namespace, {_SEEN_STEM_SQL} "
            "ORDER BY CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER), k) = 1")


@register("union_adapters", _union_sql())
def q_union_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New documents of all three dialects in one item shape, one per (namespace, stem)."""
    keys = ("namespace", "file_name", "stem", "source_ord")
    f = ingest_feed_docs(spark, sf_dir).select(F.lit("feed").alias("dialect"), *keys, F.col("link").alias("url"))
    v = ingest_video_docs(spark, sf_dir).select(F.lit("video").alias("dialect"), *keys, "url")
    li = ingest_listing_docs(spark, sf_dir).select(F.lit("listing").alias("dialect"), *keys, "url")
    return G.first_across_adapters(f, v, li).select("dialect", "namespace", "file_name", "url")


# ---------------------------------------------------------------------------
# Document sinks and the document scan
# ---------------------------------------------------------------------------

@register("sink_documents", f"SELECT namespace, file_name, CAST(length(doc_text) AS BIGINT) AS doc_chars FROM ({_ingest_sql()})")
def q_sink_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New documents appended as parquet partitioned by namespace, read back."""
    from tidepool.session import scratch_path
    from tidepool.sources.sinks import sink_documents
    docs = ingest_feed_docs(spark, sf_dir).select("namespace", "file_name", "doc_text")
    path = sink_documents(docs, scratch_path(spark, "documents"))
    back = spark.read.parquet(path)
    return back.select(F.col("namespace").cast("string").alias("namespace"), "file_name",
                       F.char_length("doc_text").cast("long").alias("doc_chars"))


def _exported_root(spark: SparkSession, sf_dir: str) -> str:
    from tidepool.session import scratch_path
    from tidepool.sources.sinks import export_markdown
    root = scratch_path(spark, "content")
    export_markdown(ingest_feed_docs(spark, sf_dir), root)
    return root


@register("scan_documents", f"""
SELECT namespace || '/' || file_name AS path, source, url, date AS published, true AS readable
FROM ({_ingest_sql()})""")
def q_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files (one per document) read back recursively: frontmatter → VARIANT."""
    from tidepool.sources.scans import meta_str, scan_documents
    docs, _bad = scan_documents(spark, _exported_root(spark, sf_dir))
    return docs.select("path", meta_str("source").alias("source"), meta_str("url").alias("url"),
                       meta_str("published").alias("published"), F.col("readable"))


@register("relative_path", f"SELECT namespace || '/' || file_name AS path FROM ({_ingest_sql()})")
def q_relative_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File paths relative to the content root, POSIX separators, percent-decoded."""
    from tidepool.sources.scans import scan_documents
    docs, _bad = scan_documents(spark, _exported_root(spark, sf_dir))
    return docs.select("path")
