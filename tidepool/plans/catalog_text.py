"""Checked queries: scalar text / URL / date expressions (§2.4) and page/transcript scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool import contracts as C
from tidepool.functions import text as TX
from tidepool.functions import urls as U
from tidepool.plans import fixtures as fx
from tidepool.plans import sqlfn as S
from tidepool.plans.catalog import register
from tidepool.plans.oracle_views import with_views
from tidepool.session import scratch_path
from tidepool.sources import scans as SC

OVERRIDE = fx.LISTING_LINK_OVERRIDE
_OVR_SQL = OVERRIDE.replace("'", "''")


# --------------------------------------------------------------------------- HTML
@register("strip_html", f"SELECT page_id, {S.strip_html('html')} AS text FROM pages")
def q_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.v_pages(spark, sf_dir).select("page_id", TX.strip_html(F.col("html")).alias("text"))


@register("main_text", f"SELECT page_id, {S.main_text('html')} AS text FROM pages")
def q_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text: boilerplate blocks and comments dropped, <article> preferred."""
    return fx.v_pages(spark, sf_dir).select("page_id", TX.main_text(F.col("html")).alias("text"))


@register("classify_content", f"""
SELECT doc_id, CASE WHEN {S.words('text')} >= 500 THEN 'full' WHEN {S.words('text')} >= 200 THEN 'truncated'
                    ELSE 'stub' END AS class,
       {S.words('text')} >= 100 AS usable_at_100
FROM documents""")
def q_classify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx._tbl(spark, sf_dir, "documents")
    return d.select("doc_id", TX.classify_content(F.col("text")).alias("class"),
                    TX.is_usable(F.col("text"), 100).alias("usable_at_100"))


@register("filter_min_words", f"SELECT page_id FROM pages WHERE {S.words(S.main_text('html'))} >= 100")
def q_filter_min_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages whose readable text has fewer than 100 words are dropped."""
    p = fx.v_pages(spark, sf_dir)
    return p.where(TX.has_min_words(TX.main_text(F.col("html")), C.MIN_BODY_WORDS_FETCH)).select("page_id")


# --------------------------------------------------------------------------- titles
@register("sanitize_title", with_views(f"""
SELECT pos, {S.sanitize_title('description')} AS stem_title FROM v_items""", "v_items"))
def q_sanitize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = fx.v_items(spark, sf_dir)
    return i.select("pos", TX.sanitize_title(F.col("description")).alias("stem_title"))


@register("md_escape", with_views(f"""
SELECT pos, {S.md_escape('description')} AS escaped FROM v_items""", "v_items"))
def q_md_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = fx.v_items(spark, sf_dir)
    return i.select("pos", TX.md_escape(F.col("description")).alias("escaped"))


@register("url_hash", f"SELECT page_id, {S.url_hash('url')} AS url_hash FROM pages")
def q_url_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.v_pages(spark, sf_dir).select("page_id", U.url_hash(F.col("url")).alias("url_hash"))


@register("date_in_text", with_views("""
SELECT doc_id, coalesce(nullif(regexp_extract(substr(body, 1, 500), '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), ''),
                        '2024-02-01') AS date FROM v_article""", "v_article"))
def q_date_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.v_article(spark, sf_dir)
    return a.select("doc_id", TX.date_in_text(F.col("body")).alias("date"))


def _title_from_body_sql(body: str = "body", url: str = "url") -> str:
    lines = f"string_split(coalesce({body}, ''), chr(10))[1:10]"
    heads = f"list_filter({lines}, lambda x: starts_with({S.py_strip('x')}, '# '))"
    first = f"{heads}[1]"
    heading = S.py_strip(f"substr({S.py_strip(first)}, 3)")
    part = f"string_split(regexp_replace(coalesce({url}, ''), '/+$', ''), '/')[-1]"
    fallback = f"(CASE WHEN {part} <> '' THEN {S.py_title(f'regexp_replace({part}, {chr(39)}[-_]{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')} ELSE 'Untitled' END)"
    return f"(CASE WHEN len({heads}) = 0 OR {heading} = 'Untitled' THEN {fallback} ELSE {heading} END)"


@register("title_from_body", with_views(f"""
SELECT doc_id, {_title_from_body_sql()} AS title FROM v_article""", "v_article"))
def q_title_from_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First '# ' heading in the first 10 lines, else the URL slug title-cased."""
    a = fx.v_article(spark, sf_dir)
    return a.select("doc_id", TX.title_from_body(F.col("body"), F.col("url")).alias("title"))


# --------------------------------------------------------------------------- links
_LINKS_SQL = f"""
SELECT page_id, url, generate_subscripts(ls, 1) - 1 AS link_pos, unnest(ls) AS link
FROM (SELECT page_id, url, regexp_extract_all(html, '{_OVR_SQL}', 1) AS ls FROM pages)"""


@register("scan_listing_links", with_views("SELECT page_id, CAST(link_pos AS BIGINT) AS link_pos, link FROM links",
                                           extra={"links": _LINKS_SQL}))
def q_scan_listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of a per-source link pattern, in page order."""
    p = fx.v_pages(spark, sf_dir)
    return SC.scan_listing_links(p, OVERRIDE).select("page_id", F.col("link_pos").cast("long").alias("link_pos"), "link")


_DLINKS_SQL = f"""
SELECT page_id, url, generate_subscripts(ls, 1) - 1 AS link_pos, unnest(ls) AS link
FROM (SELECT page_id, url, list_distinct_ordered(regexp_extract_all(html, '{_OVR_SQL}', 1)) AS ls FROM pages)"""


def _distinct_ordered_sql(arr: str) -> str:
    """First occurrences in order (DuckDB's list_distinct does not promise order)."""
    return (f"list_transform(list_filter(list_zip({arr}, generate_series(1, len({arr}))), "
            f"lambda p: list_position({arr}, p[1]) = p[2]), lambda p: p[1])")


_DLINKS_SQL = _DLINKS_SQL.replace(
    f"list_distinct_ordered(regexp_extract_all(html, '{_OVR_SQL}', 1))",
    _distinct_ordered_sql(f"regexp_extract_all(html, '{_OVR_SQL}', 1)"))


@register("distinct_links", with_views("SELECT page_id, CAST(link_pos AS BIGINT) AS link_pos, link FROM dl",
                                       extra={"dl": _DLINKS_SQL}))
def q_distinct_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links per page in first-occurrence order."""
    p = fx.v_pages(spark, sf_dir)
    return SC.distinct_links(p, OVERRIDE).select("page_id", F.col("link_pos").cast("long").alias("link_pos"), "link")


@register("slug_text", with_views("""
SELECT page_id, CAST(link_pos AS BIGINT) AS link_pos,
       regexp_replace(string_split(regexp_replace(link, '/+$', ''), '/')[-1], '[-_]', ' ', 'g') AS slug FROM dl""",
    extra={"dl": _DLINKS_SQL}))
def q_slug_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = SC.distinct_links(fx.v_pages(spark, sf_dir), OVERRIDE)
    return d.select("page_id", F.col("link_pos").cast("long").alias("link_pos"), TX.slug_text(F.col("link")).alias("slug"))


@register("resolve_link", with_views("""
SELECT page_id, CAST(link_pos AS BIGINT) AS link_pos,
       regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || link AS full_url FROM dl""",
    extra={"dl": _DLINKS_SQL}))
def q_resolve_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URL + absolute-path link → full URL (RFC 3986 join)."""
    d = SC.distinct_links(fx.v_pages(spark, sf_dir), OVERRIDE)
    return d.select("page_id", F.col("link_pos").cast("long").alias("link_pos"),
                    U.resolve_link(F.col("url"), F.col("link")).alias("full_url"))


@register("safe_link", with_views(f"""
SELECT page_id, CAST(link_pos AS BIGINT) AS link_pos, {S.safe_link('link')} AS safe FROM links""",
    extra={"links": _LINKS_SQL.replace(_OVR_SQL, 'href=\"([^\"]*)\"')}))
def q_safe_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every href of every page rendered as a safe markdown destination (null if refused)."""
    p = SC.scan_listing_links(fx.v_pages(spark, sf_dir), r'href="([^"]*)"')
    return p.select("page_id", F.col("link_pos").cast("long").alias("link_pos"), U.safe_link(F.col("link")).alias("safe"))


@register("host_allowlist", f"""
SELECT conv_id, turn, url, {S.url_scheme('url')} = 'https' AND lower({S.url_netloc('url')}) IN
       ('www.youtube.com', 'youtube.com', 'm.youtube.com', 'youtu.be') AS allowed
FROM (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'https://www.youtube.com/@c' || CAST(conv_id AS VARCHAR)
                                       WHEN 1 THEN 'http://youtube.com/@c' || CAST(conv_id AS VARCHAR)
                                       WHEN 2 THEN 'https://youtu.be:443/c' || CAST(conv_id AS VARCHAR)
                                       WHEN 3 THEN 'https://M.YouTube.com/c' || CAST(conv_id AS VARCHAR)
                                       ELSE 'https://evil.example.com/youtube.com/' || CAST(conv_id AS VARCHAR) END AS url
      FROM conversations)""")
def q_host_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel URLs may only be read over https from the exact video hosts."""
    c = fx._tbl(spark, sf_dir, "conversations")
    cid, kind = F.col("conv_id").cast("string"), (F.col("conv_id") + F.col("turn")) % 5
    url = (F.when(kind == 0, F.concat(F.lit("https://www.youtube.com/@c"), cid))
            .when(kind == 1, F.concat(F.lit("http://youtube.com/@c"), cid))
            .when(kind == 2, F.concat(F.lit("https://youtu.be:443/c"), cid))
            .when(kind == 3, F.concat(F.lit("https://M.YouTube.com/c"), cid))
            .otherwise(F.concat(F.lit("https://evil.example.com/youtube.com/"), cid)))
    return c.select("conv_id", "turn", url.alias("url")).select("conv_id", "turn", "url", U.host_allowed(F.col("url")).alias("allowed"))


def _tracker_sql() -> str:
    host = "CASE WHEN contains(req_url, '://') THEN coalesce(string_split(req_url, '/')[3], '') ELSE '' END"
    names = ", ".join(f"'{t}'" for t in C.TRACKER_HOSTS)
    return f"""
SELECT page_id, req_url, resource_type FROM (
  SELECT page_id, url AS req_url,
         CASE page_id % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'script' WHEN 3 THEN 'font'
                          ELSE 'stylesheet' END AS resource_type FROM pages
  UNION ALL
  SELECT page_id, 'https://www.' || ['google-analytics.com', 'cdn.example.org', 'static.hotjar.com'][page_id % 3 + 1]
         || '/t.js?p=' || CAST(page_id AS VARCHAR), 'script' FROM pages)
WHERE NOT (resource_type IN ('image', 'media', 'font')
           OR len(list_filter([{names}], lambda t: contains({host}, t))) > 0)"""


@register("tracker_filter", _tracker_sql())
def q_tracker_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page requests left after dropping tracker hosts and image/media/font resources."""
    p = fx.v_pages(spark, sf_dir)
    rt = (F.when(F.col("page_id") % 5 == 0, "document").when(F.col("page_id") % 5 == 1, "image")
           .when(F.col("page_id") % 5 == 2, "script").when(F.col("page_id") % 5 == 3, "font").otherwise("stylesheet"))
    own = p.select("page_id", F.col("url").alias("req_url"), rt.alias("resource_type"))
    hosts = F.array(F.lit("google-analytics.com"), F.lit("cdn.example.org"), F.lit("static.hotjar.com"))
    third = p.select("page_id", F.concat(F.lit("https://www."), F.element_at(hosts, (F.col("page_id") % 3 + 1).cast("int")),
                                         F.lit("/t.js?p="), F.col("page_id").cast("string")).alias("req_url"),
                     F.lit("script").alias("resource_type"))
    req = own.unionByName(third)
    return req.where(~U.request_dropped(F.col("req_url"), F.col("resource_type")))


# --------------------------------------------------------------------------- bodies
@register("scan_bodies_capped", """
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS body_bytes,
       octet_length(encode(html)) > 20000 AND page_id % 7 <> 0 AS rejected,
       CASE WHEN page_id % 7 = 0 THEN 0 WHEN octet_length(encode(html)) > 20000 THEN NULL
            ELSE CAST(octet_length(encode(html)) AS BIGINT) END AS kept_bytes
FROM pages""")
def q_scan_bodies_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw page bodies under a byte cap (a small cap here so both outcomes occur);
    error responses keep an empty body."""
    p = fx.v_pages(spark, sf_dir)
    bodies = p.select("page_id", F.encode("html", "UTF-8").alias("body"),
                      F.when(F.col("page_id") % 7 == 0, 500).otherwise(200).alias("status"))
    c = SC.cap_bodies(bodies, max_bytes=20000)
    return c.select("page_id", "body_bytes", "rejected", F.octet_length("body").cast("long").alias("kept_bytes"))


@register("scan_bodies_files", """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS body_bytes, octet_length(encode(coalesce(html, ''))) <= 4000 AS accepted,
       CASE WHEN octet_length(encode(coalesce(html, ''))) <= 4000 THEN md5(coalesce(html, '')) END AS body_md5
FROM pages""")
def q_scan_bodies_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's body as a file, read back by a binaryFile scan whose cap looks at file lengths only."""
    from tidepool.sources.filetree import write_files
    p = fx.v_pages(spark, sf_dir)
    folder = F.concat(F.lit("p"), (F.col("page_id") % 16).cast("string"))
    root = write_files(p.select(folder.alias("dir"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").alias("body")),
                       scratch_path(spark, "bodies"))
    accepted, over = SC.scan_bodies_capped(spark, root, "*.html", max_bytes=4000)
    page = F.regexp_extract("path", r"(\d+)\.html$", 1).cast("long").alias("page_id")
    size = F.col("length").cast("long").alias("body_bytes")
    return (accepted.select(page, size, F.lit(True).alias("accepted"), F.md5("content").alias("body_md5"))
            .unionByName(over.select(page, size, F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("body_md5"))))


@register("truncate_bodies", """
SELECT page_id, octet_length(encode(html)) > 2000 AS truncated,
       md5(CASE WHEN octet_length(encode(html)) > 2000 THEN substr(html, 1, 2000) ELSE html END) AS body_md5 FROM pages""")
def q_truncate_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered pages cut at the cap, which never splits a character."""
    t = SC.truncate_bodies(fx.v_pages(spark, sf_dir).withColumnRenamed("html", "body"), max_bytes=2000)
    return t.select("page_id", "truncated", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@register("decode_body", f"""
SELECT page_id, {S.strip_html('html')} AS text FROM pages""")
def q_decode_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page bytes decoded by declared charset (prolog > HTTP header), then tag-stripped."""
    p = fx.v_pages(spark, sf_dir)
    b = p.select("page_id", F.encode("html", "UTF-8").alias("body"),
                 F.regexp_extract("html", r'(?i)<meta charset="([^"]+)"', 1).alias("charset"))
    return b.select("page_id", TX.strip_html(SC.decode_body(F.col("body"), F.col("charset"))).alias("text"))


# --------------------------------------------------------------------------- video listing
def _listing_lines_sql() -> str:
    day = "strftime(DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER), '%Y%m%d')"
    upload = f"CASE WHEN conv_id % 4 = 1 THEN '' WHEN conv_id % 4 = 2 THEN substr({day}, 1, 6) ELSE {day} END"
    title = "CASE WHEN conv_id % 5 = 0 THEN '' ELSE ',\"title\":' || to_json(text) END"
    turn = "CASE WHEN turn > 0 THEN '-' || CAST(turn AS VARCHAR) ELSE '' END"
    id_part = f"CASE WHEN conv_id % 7 = 3 THEN '\"kind\":\"video\"' ELSE '\"id\":\"v' || CAST(conv_id AS VARCHAR) || {turn} || '\"' END"
    line = f"'{{' || {id_part} || {title} || ',\"upload_date\":\"' || {upload} || '\"}}'"
    return f"""SELECT turn * 10000000000 + conv_id AS line_no, CASE WHEN conv_id % 9 = 4 THEN '{{not json' WHEN conv_id % 9 = 8 THEN ''
                ELSE {line} END AS line FROM conversations"""


_CAPTIONS_SQL = """
SELECT line_no, id, coalesce(title, id) AS title, 'https://www.youtube.com/watch?v=' || id AS url,
       coalesce(nullif(CASE WHEN length(coalesce(ud, '')) = 8 THEN substr(ud, 1, 4) || '-' || substr(ud, 5, 2) || '-'
                                 || substr(ud, 7, 2) ELSE coalesce(ud, '') END, ''), '2024-02-01') AS upload_date
FROM (SELECT line_no, json_extract_string(line, '$.id') AS id, json_extract_string(line, '$.title') AS title,
             json_extract_string(line, '$.upload_date') AS ud
      FROM lines WHERE line <> '' AND json_valid(line))
WHERE coalesce(id, '') <> ''"""


@register("scan_captions", with_views("SELECT line_no, id, title, url, upload_date FROM caps",
                                      extra={"lines": _listing_lines_sql(), "caps": _CAPTIONS_SQL}))
def q_scan_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video listing JSON lines: bad/blank lines skipped, id required, title defaults to id."""
    return SC.scan_captions(fx.v_video_listing(spark, sf_dir)).select("line_no", "id", "title", "url", "upload_date")


@register("yyyymmdd_to_iso", with_views("SELECT id, upload_date FROM caps",
                                        extra={"lines": _listing_lines_sql(), "caps": _CAPTIONS_SQL}))
def q_yyyymmdd_to_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.scan_captions(fx.v_video_listing(spark, sf_dir)).select("id", "upload_date")
