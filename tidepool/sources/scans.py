"""Scans: raw feed/listing/transcript/document inputs → typed DataFrames.

Each scan is a narrow transform over a column of raw bodies (or a file
source), so it parallelises per row/file and needs no shuffle.  Parsers are
Spark's own (``from_xml``, ``from_json``, regex) except YAML frontmatter,
which goes through one Arrow-batched UDF (PyYAML) and comes back as JSON.
"""

from __future__ import annotations

import datetime as _dt
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool import contracts as C
from tidepool.functions.dates import pub_date, yyyymmdd_to_iso
from tidepool.functions.text import decode_html_names, strip_html

# ---------------------------------------------------------------------------
# Feeds (RSS 2.0 + Atom)
# ---------------------------------------------------------------------------

_S = T.StringType()
RSS_ITEM = T.StructType([T.StructField(n, _S) for n in
                         ("title", "link", "description", "pubDate", "published", "updated", "guid",
                          "content:encoded")])
RSS_SCHEMA = T.StructType([T.StructField("channel", T.StructType([
    T.StructField("title", _S), T.StructField("item", T.ArrayType(RSS_ITEM))]))])
ATOM_ENTRY = T.StructType([
    T.StructField("title", _S),
    T.StructField("link", T.ArrayType(T.StructType([T.StructField("_href", _S), T.StructField("_rel", _S)]))),
    T.StructField("id", _S), T.StructField("published", _S), T.StructField("updated", _S),
    T.StructField("summary", _S), T.StructField("content", _S)])
ATOM_SCHEMA = T.StructType([T.StructField("title", _S), T.StructField("entry", T.ArrayType(ATOM_ENTRY))])
#: Both dialects at once.
FEED_SCHEMA = T.StructType([*RSS_SCHEMA.fields, T.StructField("entry", T.ArrayType(ATOM_ENTRY))])


def _first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


# What may stand before a feed's root element: byte order mark, white space,
# declarations and processing instructions, comments, a document type.
_PROLOG_RE = (r"(?s)^[\uFEFF\s]*+(?:<\?(?:(?!\?>).)*+\?>\s*+|<!--(?:(?!-->).)*+-->\s*+"
              r"|<!DOCTYPE[^>\[]*+(?:\[[^\]]*+\]\s*+)?>\s*+)*+")


def feed_dialect(body: Column) -> Column:
    """'rss' or 'atom' by the root element a feed starts with, else null."""
    return F.when(body.rlike(r"^<rss\b"), "rss").when(body.rlike(r"^<(?:\w+:)?feed\b"), "atom")


def _feeds_by_dialect(feeds: DataFrame, xml_col: str) -> DataFrame:
    # from the root element on, HTML's named entities (which XML does not know) decoded
    d = feeds.withColumn(xml_col, F.regexp_replace(F.col(xml_col), _PROLOG_RE, ""))
    d = d.withColumn(xml_col, decode_html_names(F.col(xml_col)))
    return d.withColumn("_dialect", feed_dialect(F.col(xml_col)))


def feed_quarantine(feeds: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Feeds that give no entries because they cannot be read: (…, reason).

    ``not_a_feed``: no RSS or Atom root element; ``unreadable``: the XML does
    not parse.  A feed that parses and has no entries is not listed.
    """
    keep = [c for c in feeds.columns if c != xml_col]
    d = _feeds_by_dialect(feeds, xml_col)
    rss = F.from_xml(F.col(xml_col), RSS_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    atom = F.from_xml(F.col(xml_col), ATOM_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    reason = (F.when(F.col("_dialect").isNull(), "not_a_feed")
               .when((F.col("_dialect") == "rss") & rss["channel"].isNull(), "unreadable")
               .when((F.col("_dialect") == "atom") & atom["title"].isNull() & atom["entry"].isNull()
                     & ~F.col(xml_col).rlike(r"(?s)^<(?:\w+:)?feed\b[^>]*(/>|>.*</(?:\w+:)?feed\s*>)\s*$"), "unreadable"))
    return d.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*keep, "reason")


def scan_feed_raw(feeds: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Entries as parsed, before any text cleaning: (…, pos, title, link, pub_raw,
    summary_raw, content_raw, entry_id).  Cheap enough to run before a limit.
    What cannot be read is listed by :func:`feed_quarantine`."""
    keep = [c for c in feeds.columns if c != xml_col]
    d = _feeds_by_dialect(feeds, xml_col).where(F.col("_dialect").isNotNull())
    # one parse for both dialects: the root element's name does not matter to from_xml
    d = d.select(*keep, "_dialect", F.from_xml(F.col(xml_col), FEED_SCHEMA).alias("_feed"))
    found = F.when(F.col("_dialect") == "rss", F.transform(F.col("_feed")["channel"]["item"], _rss_entry)) \
        .otherwise(F.transform(F.col("_feed")["entry"], _atom_entry))
    return d.select(*keep, F.posexplode(found).alias("pos", "_e")).select(*keep, F.col("pos").cast("long").alias("pos"), "_e.*")


def _rss_entry(e: Column) -> Column:
    return F.struct(
        e["title"].alias("title"), F.coalesce(e["link"], F.lit("")).alias("link"),
        _first_nonempty(e["published"], e["updated"], e["pubDate"]).alias("pub_raw"),
        e["description"].alias("summary_raw"), e["content:encoded"].alias("content_raw"),
        F.coalesce(e["guid"], F.lit("")).alias("entry_id"))


def _atom_entry(e: Column) -> Column:
    alternate = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return F.struct(
        e["title"].alias("title"),
        F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get(e["link"], F.lit(0))["_href"], F.lit("")).alias("link"),
        _first_nonempty(e["published"], e["updated"]).alias("pub_raw"),
        e["summary"].alias("summary_raw"), e["content"].alias("content_raw"),
        F.coalesce(e["id"], F.lit("")).alias("entry_id"))


def finish_entries(raw: DataFrame, run_date: str = C.RUN_DATE) -> DataFrame:
    """Tag-strip title/description/content and parse the date.

    content is ``content:encoded`` when present (even if empty), else the
    description; ``date`` is the UTC day of the first non-empty date field, and
    ``date_known`` is false where that is missing or fits no form (the run date stands in).
    """
    description = strip_html(F.col("summary_raw"))
    return (raw.withColumn("title", strip_html(F.col("title")))
            .withColumn("description", description)
            .withColumn("content", F.when(F.col("content_raw").isNotNull(), strip_html(F.col("content_raw")))
                        .otherwise(description))
            .withColumn("_date", pub_date(F.col("pub_raw"), run_date))
            .withColumn("date", F.coalesce("_date", F.lit(run_date))).withColumn("date_known", F.col("_date").isNotNull())
            .drop("summary_raw", "content_raw", "_date"))


def scan_feed(feeds: DataFrame, xml_col: str = "xml", run_date: str = C.RUN_DATE) -> DataFrame:
    """One row per feed entry, in feed order (``pos``), both dialects in one shape:
    the input's other columns + pos, title, link, pub_raw, description, content,
    entry_id, date, date_known (see :func:`scan_feed_raw` and :func:`finish_entries`)."""
    return finish_entries(scan_feed_raw(feeds, xml_col), run_date)


def scan_feed_files(spark: SparkSession, path: str, glob: str = "*.xml", run_date: str = C.RUN_DATE) -> DataFrame:
    """Stored feed files (RSS or Atom, any mix) → entries, one file per row
    before parsing (feed files are small; files parse in parallel).
    ``feed_path`` is the file's path (percent-decoded)."""
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
           .text(path, wholetext=True)
           .select(percent_decode(F.col("_metadata.file_path")).alias("feed_path"), F.col("value").alias("xml")))
    return scan_feed(raw, run_date=run_date)


# ---------------------------------------------------------------------------
# Video listings (JSON lines) and transcripts
# ---------------------------------------------------------------------------

VIDEO_LINE = T.StructType([T.StructField("id", _S), T.StructField("title", _S), T.StructField("upload_date", _S)])
VIDEO_URL_PREFIX = "https://www.youtube.com/watch?v="


def scan_captions(lines: DataFrame, line_col: str = "line", run_date: str = C.RUN_DATE) -> DataFrame:
    """Video listing lines → (id, title, url, upload_date ISO).

    Blank and malformed lines are skipped, an id is required, the title
    defaults to the id, 8-character upload dates become ``YYYY-MM-DD`` and a
    missing one becomes the run date.
    """
    keep = [c for c in lines.columns if c != line_col]
    p = lines.select(*keep, F.from_json(F.col(line_col), VIDEO_LINE, {"mode": "PERMISSIVE"}).alias("v"))
    ok = p.where(F.coalesce(F.col("v.id"), F.lit("")) != "")
    return ok.select(*keep, F.col("v.id").alias("id"), F.coalesce(F.col("v.title"), F.col("v.id")).alias("title"),
                     F.concat(F.lit(VIDEO_URL_PREFIX), F.col("v.id")).alias("url"),
                     yyyymmdd_to_iso(F.col("v.upload_date"), run_date).alias("upload_date"))


# ---------------------------------------------------------------------------
# Listing pages
# ---------------------------------------------------------------------------

def scan_listing_links(pages: DataFrame, pattern: str | Column = C.DEFAULT_LISTING_LINK_PATTERN,
                       html_col: str = "html") -> DataFrame:
    """Every match of the link pattern (group 1) in page order: (…, link_pos, link).

    ``pattern`` may be a column (per-source override) or a literal.
    """
    keep = [c for c in pages.columns if c != html_col]
    pat = pattern if isinstance(pattern, Column) else F.lit(pattern)
    return pages.select(*keep, F.posexplode(F.regexp_extract_all(F.col(html_col), pat, 1)).alias("link_pos", "link"))


def distinct_links(pages: DataFrame, pattern: str | Column = C.DEFAULT_LISTING_LINK_PATTERN,
                   html_col: str = "html") -> DataFrame:
    """Distinct links per page in first-occurrence order (``array_distinct`` keeps order)."""
    keep = [c for c in pages.columns if c != html_col]
    pat = pattern if isinstance(pattern, Column) else F.lit(pattern)
    links = F.array_distinct(F.regexp_extract_all(F.col(html_col), pat, 1))
    return pages.select(*keep, F.posexplode(links).alias("link_pos", "link"))


# ---------------------------------------------------------------------------
# Raw bodies with a size cap
# ---------------------------------------------------------------------------

def cap_bodies(bodies: DataFrame, body_col: str = "body", status_col: str | None = "status",
               max_bytes: int = C.MAX_BODY_BYTES) -> DataFrame:
    """A redirect or error status (≥ 300) yields an empty body (nothing is read); otherwise
    a body over ``max_bytes`` is rejected whole (``rejected`` = true, body null)."""
    size = F.octet_length(F.col(body_col))
    failed = (F.col(status_col) >= 300) if status_col else F.lit(False)
    over = (size > max_bytes) & ~failed
    body = F.when(failed, F.lit(b"").cast("binary")).when(over, F.lit(None).cast("binary")).otherwise(F.col(body_col))
    return bodies.withColumn("body_bytes", size.cast("long")).withColumn("rejected", over) \
        .withColumn(body_col, body)


def truncate_bodies(pages: DataFrame, body_col: str = "body", max_bytes: int = C.MAX_BODY_BYTES) -> DataFrame:
    """Rendered pages over the cap are cut, not rejected: text of more than ``max_bytes``
    UTF-8 bytes keeps its first ``max_bytes`` characters (a cut never splits a
    character); ``truncated`` marks them."""
    over = F.coalesce(F.octet_length(body_col) > max_bytes, F.lit(False))
    cut = F.when(over, F.substring(body_col, 1, max_bytes)).otherwise(F.col(body_col))
    return pages.withColumn("truncated", over).withColumn(body_col, cut)


def scan_bodies_capped(spark: SparkSession, path: str, glob: str = "*",
                       max_bytes: int = C.MAX_BODY_BYTES) -> tuple[DataFrame, DataFrame]:
    """``binaryFile`` scan: (accepted, over_cap) — the length predicate is a data filter
    evaluated from file metadata, so over-cap files are never read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.where(F.col("length") <= max_bytes), raw.where(F.col("length") > max_bytes).select("path", "length")


# Charsets Spark's ``decode`` accepts.
NATIVE_CHARSETS = ("US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32")


def decode_body(body: Column, http_charset: Column) -> Column:
    """Bytes → text.  An XML prolog that declares an encoding (first 200 bytes)
    wins over the HTTP charset; invalid UTF-8 is replaced, never raised."""
    head = F.decode(F.substring(body, 1, 200), "ISO-8859-1")
    prolog = F.upper(F.regexp_extract(head, r"(?i)<\?xml[^>]*\bencoding\s*=\s*[\"']?([A-Za-z0-9._-]+)", 1))
    cs = F.upper(F.coalesce(F.nullif(prolog, F.lit("")), F.nullif(F.trim(http_charset), F.lit("")), F.lit("UTF-8")))
    cs = F.when(cs == "LATIN-1", F.lit("ISO-8859-1")).when(cs == "ASCII", F.lit("US-ASCII")).otherwise(cs)
    native = cs.isin(*NATIVE_CHARSETS)
    # Python decodes only the rows with a charset Spark lacks (others pass null)
    out = F.when(cs == "UTF-8", F.make_valid_utf8(body.cast("string")))
    for c in NATIVE_CHARSETS:
        if c != "UTF-8":
            out = out.when(cs == c, F.decode(body, c))
    return out.otherwise(_decode_udf(F.when(~native, body), F.when(~native, cs)))


@F.pandas_udf(T.StringType())
def _decode_udf(body: pd.Series, cs: pd.Series) -> pd.Series:
    out = []
    for b, c in zip(body, cs):
        if b is None:
            out.append(None)
            continue
        try:
            out.append(bytes(b).decode(c or "utf-8", errors="replace"))
        except LookupError:
            out.append(bytes(b).decode("utf-8", errors="replace"))
    return pd.Series(out)


# ---------------------------------------------------------------------------
# Markdown documents with YAML frontmatter
# ---------------------------------------------------------------------------

#: Splits that a task reads one after another: Spark reckons 4 MB for opening a file, so that a split has 32 small files at most.
SPLITS_PER_TASK = 16

FRONTMATTER_RE = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)(.*)$"


def _json_default(v):
    if isinstance(v, (_dt.date, _dt.datetime)):
        return v.isoformat()
    return str(v)


def _yaml_to_json(s: pd.Series) -> pd.Series:
    """YAML text → JSON text (null when it does not parse); dates become ISO strings."""
    import yaml
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # libyaml when built in: same safe schema, ~9x faster

    def conv(x):
        if x is None:
            return None
        try:
            return json.dumps(yaml.load(x, Loader=loader), default=_json_default, ensure_ascii=False)
        except Exception:  # noqa: BLE001 — malformed YAML → null (quarantine)
            return None
    return s.map(conv)


yaml_to_json = F.pandas_udf(_yaml_to_json, T.StringType())
#: The same, run once for each row: filters on what it returns are not moved below it with a second call.
_yaml_to_json_once = F.pandas_udf(_yaml_to_json, T.StringType()).asNondeterministic()


def split_frontmatter(text: Column) -> tuple[Column, Column]:
    """(frontmatter YAML text or null, body)."""
    has = text.rlike(FRONTMATTER_RE)
    fm = F.when(has, F.regexp_extract(text, FRONTMATTER_RE, 1))
    body = F.when(has, F.regexp_extract(text, FRONTMATTER_RE, 2)).otherwise(text)
    return fm, body


def parse_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``meta`` (VARIANT of the frontmatter mapping, null if malformed),
    ``body`` and ``readable`` (frontmatter parsed to a mapping, or absent)."""
    fm, body = split_frontmatter(F.col(text_col))
    j = docs.withColumn("_fm", fm).withColumn("body", body)
    j = j.withColumn("_json", F.when(F.col("_fm").isNotNull(), _yaml_to_json_once(F.col("_fm"))))
    meta = F.try_parse_json(F.col("_json"))
    is_obj = F.coalesce(F.schema_of_variant(meta).startswith("OBJECT"), F.lit(False))
    return (j.withColumn("meta", F.when(is_obj, meta))
             .withColumn("readable", F.col("_fm").isNull() | is_obj)
             .drop("_fm", "_json"))


def scan_documents(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Recursively read ``*.md`` under ``root``: (documents, quarantine).

    One row per file (whole text), ``path`` relative to ``root`` with POSIX
    separators, ordered by nothing — callers sort by path parts when needed.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")
             .load(root)  # the text source takes several times as long for a small file
             .select(F.col("content").cast("string").alias("text"), F.col("_metadata.file_path").alias("file_path")))
    raw = _join_splits(files)
    root_uri = root.rstrip("/") + "/"
    rel = F.regexp_replace(percent_decode(F.col("file_path")), r"^(file:)?/*" + _re_escape(root_uri.lstrip("/")), "")
    parsed = parse_documents(raw.withColumn("path", rel))
    ok = parsed.where(F.col("readable"))
    bad = parsed.where(~F.col("readable")).select("path")
    return ok, bad


def _join_splits(files: DataFrame) -> DataFrame:
    """A scan of small files with fewer tasks, each of up to ``SPLITS_PER_TASK`` splits, but enough for all cores."""
    splits = files.rdd.getNumPartitions()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(4 * cores, -(-splits // SPLITS_PER_TASK)))


def percent_decode(path: Column) -> Column:
    """%XX escapes decoded; a plus sign stays one (paths are not form data)."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def meta_str(key: str) -> Column:
    """A frontmatter value as text: strings as is, other scalars stringified."""
    v = F.try_variant_get(F.col("meta"), f"$.{key}", "variant")
    t = F.schema_of_variant(v)
    return F.when(t == "STRING", F.try_variant_get(v, "$", "string")) \
        .when(t.isin("NULL", "VOID") | v.isNull(), F.lit(None).cast("string")) \
        .otherwise(F.to_json(v))


def meta_bool_true(key: str) -> Column:
    """Exactly the boolean true (string "true" or 1 are not accepted)."""
    v = F.try_variant_get(F.col("meta"), f"$.{key}", "variant")
    return F.coalesce(F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")),
                      F.lit(False))


def ensure_list(v: Column) -> Column:
    """VARIANT → array<string>: null → [], string → [s], list → its string
    forms (non-strings stringified), other scalars and objects → []."""
    t = F.schema_of_variant(v)
    arr = F.try_variant_get(v, "$", "array<variant>")
    as_str = F.transform(arr, lambda x: F.when(F.schema_of_variant(x) == "STRING",
                                                F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x)))
    return (F.when(v.isNull() | t.isin("NULL", "VOID"), F.array().cast("array<string>"))
             .when(t == "STRING", F.array(F.try_variant_get(v, "$", "string")))
             .when(t.startswith("ARRAY"), as_str)
             .otherwise(F.array().cast("array<string>")))
