"""Stand-in inputs derived from the driver tables (FIXTURES.md §B).

Each view only shapes driver rows into the schema a job expects (feed
entries, documents, model responses, fetch logs …); none of them does a
job's work.  Integer arithmetic on ids, no randomness, no wall clock.
Every view has a DuckDB twin in :mod:`tidepool.plans.oracle_views`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import prepare, read_table, shuffle_partitions

# Fixed inputs of the checked queries (parameters, not results).
VOCABULARY = ("de", "en", "es", "fr", "long")
ALIASES = (  # (variant, canonical); 'THE' repeats 'the' after folding: last wins
    ("the", "The Org"),
    ("la", "La Maison"),
    ("der", "Der Verlag"),
    ("THE", "The Organisation"),
    ("SS", "Eszett GmbH"),  # folds to 'ss', as 'ß' does
)


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _tbl(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return read_table(spark, sf_dir, name)


# ---------------------------------------------------------------------------
# Items, documents, index
# ---------------------------------------------------------------------------

def v_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _tbl(spark, sf_dir, "documents")
    did = F.col("doc_id")
    link = F.when(did % 11 == 0, F.lit("")).otherwise(
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"), _s(did)))
    guid = F.when(did % 22 == 0, F.lit("")).otherwise(F.concat(F.lit("g"), _s(did)))
    published = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (did % 30).cast("int")), "yyyy-MM-dd")
    return d.select(
        did.alias("doc_id"), did.alias("pos"), "source", "lang",
        # longer than a title may be, so that the cut is exercised; some with entities
        F.concat(F.when(did % 9 == 0, F.lit("Caf&eacute; &#8217;24 &amp;lt; ")).otherwise(F.lit("")), F.substring("text", 1, 150)).alias("title"),
        F.col("text").alias("description"),
        F.col("text").alias("content"), link.alias("link"), guid.alias("guid"),
        published.alias("published"), F.col("source").alias("namespace"), "n_chars")


def doc_path(source, doc_id):
    return F.concat(source, F.lit("/"), F.lpad(_s(doc_id), 8, "0"), F.lit(".md"))


def v_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = v_items(spark, sf_dir)
    labels = _tbl(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return (items.join(labels, "doc_id", "left")
            .withColumn("path", doc_path(F.col("source"), F.col("doc_id")))
            .withColumn("enriched", F.col("quality") == 1))


def v_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    did = F.col("doc_id")
    empty = F.array().cast("array<string>")
    primary = (F.when(did % 7 == 0, empty)
                .when(did % 3 == 0, F.array(F.col("lang"), F.lit("long")))
                .otherwise(F.array(F.col("lang"))))
    secondary = F.when(F.col("toxic") == 1, F.array(F.lit("flagged"))).otherwise(empty)
    return (v_docs(spark, sf_dir).where(F.col("enriched"))
            .select("doc_id", "path", "title", "source",
                    F.col("link").alias("url"),
                    F.when(did % 13 == 0, F.lit("")).otherwise(F.col("published")).alias("published"),
                    F.array(F.lit("feed"), F.col("lang")).alias("tags"),
                    primary.alias("primary_topics"), secondary.alias("secondary_topics"),
                    F.col("content").alias("summary"),
                    F.create_map(F.lit("organizations"), F.array("lang", "source"), F.lit("venues"), F.array("source")).alias("entities"),
                    F.col("enriched")))


def v_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = v_items(spark, sf_dir)
    did = F.col("doc_id")
    body = F.when(did % 2 == 0, F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("published"),
                                         F.lit("\n\n"), F.col("content"))).otherwise(F.col("content"))
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/posts/"), F.col("lang"),
                   F.lit("-report_"), _s(did))
    return i.select("doc_id", "source", url.alias("url"), body.alias("body"), "link")


# ---------------------------------------------------------------------------
# Registry (source dimension) — settings by a rule on the source number
# ---------------------------------------------------------------------------

def registry_from_sources(sources: DataFrame) -> DataFrame:
    """One registry row per distinct source name (``srcN``)."""
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    kf_mode = F.when(n % 4 == 0, F.lit(None).cast("string")).when(n % 4 == 1, "any") \
        .when(n % 4 == 2, "all").otherwise("some")
    kf_include = (F.when(n % 4 == 0, F.array().cast("array<string>"))
                   .when(n % 4 == 1, F.array(F.lit("The"), F.lit("le"), F.lit("der")))
                   .when(n % 4 == 2, F.array(F.lit("e"), F.lit("a")))
                   .otherwise(F.array(F.lit("que"), F.lit("ING"))))
    return sources.select(
        F.col("source").alias("name"),
        n.alias("source_ord"),
        F.when(n % 5 == 3, "youtube").when(n % 5 == 4, "listing").otherwise("rss").alias("type"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/feed")).alias("feed_url"),
        F.concat(F.lit("ns"), _s(n % 4)).alias("output_dir"),  # sources of different types share a folder
        F.array(F.lit("feed"), F.concat(F.lit("t"), _s(n % 3))).alias("tags"),
        F.when(n % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("p"), _s(n))).alias("perspective"),
        (F.lit(10) + (n % 7) * 3).alias("scrape_limit"),
        (n % 2 == 0).alias("scrape_full_content"),
        F.concat(F.lit("g"), _s(n % 3)).alias("throttle_group"),
        F.when(n % 2 == 0, F.lit(10.0)).otherwise(F.lit(0.0)).alias("throttle_seconds"),
        kf_mode.alias("kf_mode"), kf_include.alias("kf_include"),
        F.lit(None).cast("string").alias("listing_link_pattern"),
        (n % 10 != 9).alias("enabled"))


def v_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _tbl(spark, sf_dir, "documents").select("source").distinct()
    return registry_from_sources(src)


# ---------------------------------------------------------------------------
# Dedup view
# ---------------------------------------------------------------------------

def v_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _tbl(spark, sf_dir, "documents")
    did = F.col("doc_id")
    key = F.when(did % 10 < 2, did - did % 2).otherwise(did)
    return (d.select(did.alias("pos"), "source", key.alias("key_id"), F.col("text").alias("description"))
            .select("pos", "source", "key_id", "description",
                    F.concat(F.lit("Report "), _s("key_id")).alias("title"),
                    F.when(F.col("key_id") % 11 == 0, F.lit(""))
                     .otherwise(F.concat(F.lit("https://f.example.com/"), _s("key_id"))).alias("link"),
                    F.when(F.col("key_id") % 22 == 0, F.lit(""))
                     .otherwise(F.concat(F.lit("g"), _s("key_id"))).alias("guid"),
                    F.concat(F.lit("ns"), _s(F.col("key_id") % 4)).alias("namespace")))


def v_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names already on disk from an earlier run (keys with key_id % 6 = 0)."""
    v = v_dedup(spark, sf_dir).where(F.col("key_id") % 6 == 0)
    ident = F.coalesce(F.nullif("link", F.lit("")), F.nullif("guid", F.lit("")),
                       F.concat("title", F.lit("\n"), "description"))
    name = F.concat(F.lit("2023-12-31 - "), F.col("title"), F.lit("-"),
                    F.substring(F.sha1(F.encode(ident, "UTF-8")), 1, 6), F.lit(".md"))
    return v.select("namespace", name.alias("file_name")).distinct()


# ---------------------------------------------------------------------------
# Feed documents (RSS 2.0 on even ids, Atom on odd ids)
# ---------------------------------------------------------------------------

def _xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


# Fixed fixture values: UTC offsets used for the feed timestamps.
_OFFSETS = ("+0000", "-0500", "+0900", "GMT")
_ISO_OFFSETS = ("+00:00", "-05:00", "+09:00", "Z")


def v_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = v_items(spark, sf_dir)
    did = F.col("doc_id")
    local_ts = F.to_timestamp(F.concat(F.col("published"), F.lit(" "),
                                       F.lpad(_s(did % 24), 2, "0"), F.lit(":30:00")))
    off_idx = (did % 4).cast("int")
    rfc_off = F.element_at(F.array(*[F.lit(o) for o in _OFFSETS]), off_idx + 1)
    iso_off = F.element_at(F.array(*[F.lit(o) for o in _ISO_OFFSETS]), off_idx + 1)
    # named columns, so that the long texts are built once and not copied into every use
    i = i.select("doc_id", "source", *[_xml_escape(F.col(c)).alias(c) for c in ("title", "description", "link", "guid")],
                 F.concat(F.date_format(local_ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" "), rfc_off).alias("pub_rfc"),
                 F.concat(F.date_format(local_ts, "yyyy-MM-dd'T'HH:mm:ss"), iso_off).alias("pub_iso"))
    t, d, l, g, pub_rfc, pub_iso = (F.col(c) for c in ("title", "description", "link", "guid", "pub_rfc", "pub_iso"))
    def rss_item(title, desc, more):
        return F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), _suffixed(l, more), F.lit("</link><pubDate>"), pub_rfc,
                        F.lit("</pubDate><description>"), desc, F.lit('</description><guid isPermaLink="false">'), _suffixed(g, more), F.lit("</guid></item>"))

    def atom_entry(title, desc, more):
        return F.concat(F.lit("<entry><title>"), title, F.lit('</title><link href="'), F.replace(_suffixed(l, more), F.lit('"'), F.lit("&quot;")), F.lit('"/><id>'),
                        _suffixed(g, more), F.lit("</id><published>"), pub_iso, F.lit("</published><summary>"), desc, F.lit("</summary></entry>"))

    def entries(make):  # every third feed has a second entry
        return F.concat(make(t, d, ""), F.when(did % 3 == 0, make(F.concat(F.lit("Second "), t), t, "/2")).otherwise(F.lit("")))

    # what feeds in the wild have before the root element, and an HTML entity
    prolog = (F.when(did % 5 == 1, F.lit('<?xml version="1.0"?>\n<?xml-stylesheet type="text/xsl" href="feed.xsl"?>\n'))
               .when(did % 5 == 2, F.lit("\ufeff<!-- " + "c" * 2100 + " -->\n"))
               .when(did % 5 == 3, F.lit('<!DOCTYPE feed [ <!ENTITY x "y"> ]>\n')).otherwise(F.lit("")))
    head = F.concat(F.col("source"), F.when(did % 5 == 4, F.lit("&nbsp;&eacute;")).otherwise(F.lit("")))
    rss = F.concat(F.lit('<rss version="2.0"><channel><title>'), head, F.lit("</title>"), entries(rss_item), F.lit("</channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>'), head, F.lit("</title>"), entries(atom_entry), F.lit("</feed>"))
    xml = F.concat(prolog, F.when(did % 2 == 0, rss).otherwise(atom))
    broken = (F.when(did % 50 == 7, F.lit("<html><body>Not found</body></html>"))
               .when(did % 50 == 8, F.lit("<rss version='2.0'><channel><item><title>cut of")).otherwise(xml))
    return i.select("doc_id", "source", F.when(did % 2 == 0, F.lit("rss")).otherwise(F.lit("atom")).alias("dialect"), broken.alias("xml"))


def _suffixed(c, more: str):
    """A link or id of a later entry: empty stays empty."""
    return F.when(c == "", c).otherwise(F.concat(c, F.lit(more)))


# ---------------------------------------------------------------------------
# Pages, transcripts, events, checks, usage
# ---------------------------------------------------------------------------

LISTING_LINK_OVERRIDE = r'href="(/[^"#?]+)"'


def v_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small listing page per article: navigation links that must not match
    the default pattern, the article link twice, and a feed link."""
    a = v_items(spark, sf_dir)
    art = F.concat(F.lit("/posts/"), F.col("lang"), F.lit("-report_"), _s("doc_id"))
    html = F.concat(
        F.lit('<html><body><nav><a href="/login">Log in</a> <a href="/signup">Sign up</a></nav><h2><a href="'), art,
        F.lit('">'), _xml_escape(F.col("title")), F.lit('</a></h2><p><a href="'), art,
        F.lit('">more</a> · <a href="/feed.xml">feed</a></p></body></html>'))
    return a.select(F.col("doc_id").alias("page_id"), "source",
                    F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/blog/")).alias("feed_url"),
                    html.alias("html"))


def v_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tbl(spark, sf_dir, "pages").select("page_id", "url", "html")


def v_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tbl(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("video"), F.col("turn").alias("seq"),
                    F.col("text").alias("segment"),
                    F.when(F.col("role") == "assistant", "manual_en")
                     .when(F.col("role") == "user", "generated_en").otherwise("other").alias("track"))


def v_video_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per video listing entry, one for each turn of each conversation, with
    the turn's whole text as title; conversations' first turns are listed first.
    Only those have captions (:func:`v_conv`).  Some lines are malformed, lack
    an id, a title, or have odd upload dates."""
    c = _tbl(spark, sf_dir, "conversations")
    line_no = F.col("turn") * F.lit(10_000_000_000) + F.col("conv_id")
    cid = F.col("conv_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (cid % 30).cast("int")), "yyyyMMdd")
    upload = F.when(cid % 4 == 1, F.lit("")).when(cid % 4 == 2, F.substring(day, 1, 6)).otherwise(day)
    # to_json(array(x)) → ["..."]; keep the quoted element only
    title_part = F.when(cid % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit(',"title":'), F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")))
    id_part = F.when(cid % 7 == 3, F.lit('"kind":"video"')).otherwise(
        F.concat(F.lit('"id":"v'), _s(cid), F.when(F.col("turn") > 0, F.concat(F.lit("-"), _s("turn"))).otherwise(F.lit("")), F.lit('"')))
    line = F.concat(F.lit("{"), id_part, title_part, F.lit(',"upload_date":"'), upload, F.lit('"}'))
    line = F.when(cid % 9 == 4, F.lit("{not json")).when(cid % 9 == 8, F.lit("")).otherwise(line)
    src = F.concat(F.lit("src"), _s(cid % 20))
    return c.select(line_no.alias("line_no"), src.alias("source"), line.alias("line"))


def v_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch log: group = user, start = ts, completion = ts + value seconds.
    Times are integer microseconds so every engine does the same arithmetic."""
    e = _tbl(spark, sf_dir, "events")
    ts_us = F.unix_micros(F.col("ts").cast("timestamp"))
    dur_us = F.floor(F.col("value") * 1000000 + 0.5)
    group = F.when(F.col("event_id") % 8 != 5, F.col("user_id"))  # some fetches have no group
    return e.select("event_id", group.alias("throttle_group"), ts_us.alias("ts_us"),
                    (ts_us + dur_us).alias("end_us"), F.lit(3600 * 1000000).cast("bigint").alias("throttle_us"),
                    "user_id", "event_type")


def v_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _tbl(spark, sf_dir, "events")
    status = (F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 301)
               .when(F.col("event_type") == "purchase", 404).when(F.col("event_type") == "signup", 503))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.concat(F.lit("https://h"), _s("user_id"), F.lit(".example.com/"), _s("event_id")).alias("url"),
                    status.cast("int").alias("status"), _s("user_id").alias("source"))


def host_ips_for(hosts: DataFrame) -> DataFrame:
    """Name-resolution table for a set of hosts (rule on the host's length)."""
    n = F.char_length("host")
    ip = (F.when(n % 6 == 0, F.lit("127.0.0.1"))
           .when(n % 6 == 1, F.concat(F.lit("192.168.1."), _s(n)))
           .when(n % 6 == 3, F.lit("169.254.169.254"))
           .when(n % 6 == 2, F.lit(None).cast("string"))
           .otherwise(F.concat(F.lit("93.184.216."), _s(n))))
    second = F.when(n % 6 == 4, F.concat(F.lit("10.0.0."), _s(n)))
    rows = hosts.select("host", F.explode(F.array(ip, second)).alias("ip"))
    return rows.where(F.col("ip").isNotNull())


def v_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tbl(spark, sf_dir, "conversations")
    chars = F.char_length("text").cast("bigint")
    return c.select("conv_id", "turn", F.col("role").alias("model"), chars.alias("input_tokens"),
                    F.col("turn").alias("cache_read"), F.lit(None).cast("bigint").alias("cache_creation"),
                    F.floor(chars / 4).cast("bigint").alias("output_tokens"))


# ---------------------------------------------------------------------------
# Entities and enrichment candidates
# ---------------------------------------------------------------------------

def v_entities(spark: SparkSession, sf_dir: str, by_doc: bool = False) -> DataFrame:
    # spread over all tasks, however few parts the stored table can be read in; by document
    # alone for a job that groups by it, so that the texts are dealt once and not their words
    d = _tbl(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.repartition(shuffle_partitions(spark), F.col("doc_id")) if by_doc else d.repartition(F.col("doc_id"), F.xxhash64("text"))
    toks = F.split(F.col("text"), r"\s+")
    return (d.select("doc_id", F.posexplode(toks).alias("pos", "tok"))
            .select("doc_id", "pos",
                    F.when(F.col("pos") % 2 == 1, F.upper("tok")).otherwise(F.col("tok")).alias("token")))


def v_aliases(spark: SparkSession) -> DataFrame:
    # an Arrow table becomes a local relation: Spark knows its size and broadcasts it in joins
    import pyarrow as pa
    rows = [{"alias_ord": i, "alias": a, "canonical": c} for i, (a, c) in enumerate(ALIASES)]
    return spark.createDataFrame(pa.Table.from_pylist(rows, pa.schema([("alias_ord", pa.int32()), ("alias", pa.string()), ("canonical", pa.string())])))


def v_vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v,) for v in VOCABULARY], "term string")


def v_rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v_docs(spark, sf_dir).select("doc_id", "path", "lang", "content", "n_chars")
    # spread over all tasks, however few parts the stored table can be read in
    docs = docs.repartition(F.col("doc_id"), F.xxhash64("content"))
    words = F.split(F.col("content"), " ")  # the lists are a document's, the same for all its attempts
    docs = docs.withColumn("organizations", F.filter(words, lambda w: w.rlike("^[A-Z]"))).withColumn("people", F.filter(words, lambda w: F.char_length(w) > 14))
    rows = docs.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt"))
    k = F.col("doc_id") + F.col("attempt")
    empty = F.array().cast("array<string>")
    summary = F.when(k % 5 == 0, F.substring("content", 1, 50)).otherwise(F.col("content"))
    primary = F.when(k % 7 == 0, F.array(F.col("lang"), F.lit("offtopic"))).otherwise(F.array(F.col("lang")))
    secondary = F.when(F.col("n_chars") > 2000, F.array(F.lit("long"))).otherwise(empty)
    entities = F.when(k % 11 == 0, F.lit(None)).otherwise(F.struct("organizations", "people"))
    takeaways = F.when(k % 13 == 0, F.transform(F.sequence(F.lit(1), F.lit(9)),
                                                lambda x: F.concat(F.lit("point "), _s(x)))) \
        .otherwise(F.array(F.lit("point 1"), F.lit("point 2")))
    return rows.select(
        "doc_id", "path", "attempt", (k % 17 != 0).alias("enriched"), summary.alias("summary"),
        F.struct(primary.alias("primary"), secondary.alias("secondary")).alias("topics"),
        entities.alias("entities"), takeaways.alias("key_takeaways"))


def _yaml_str(c):
    """A YAML double-quoted scalar (JSON string syntax is valid YAML)."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _yaml_list(c):
    return F.coalesce(F.to_json(c), F.lit("[]"))


def v_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses: the candidate record as fenced YAML text, with
    responses that hold no mapping, an injected key, or a non-string topic."""
    r = v_rec(spark, sf_dir)
    k = F.col("doc_id") + F.col("attempt")
    primary = F.when(k % 29 == 0, F.concat(F.lit("[{AI: alignment}, "), F.expr("substr(to_json(topics.primary), 2)")))\
        .otherwise(_yaml_list(F.col("topics.primary")))
    ents = F.when(F.col("entities").isNull(), F.lit("")).otherwise(F.concat(
        F.lit("entities:\n  organizations: "), _yaml_list(F.col("entities.organizations")),
        F.lit("\n  people: "), _yaml_list(F.col("entities.people")), F.lit("\n")))
    extra = F.when(k % 23 == 0, F.lit("injected: \"drop me\"\n")).otherwise(F.lit(""))
    body = F.concat(
        F.lit("enriched: "), F.when(F.col("enriched"), F.lit("true")).otherwise(F.lit("false")), F.lit("\n"),
        F.lit("summary: "), _yaml_str(F.col("summary")), F.lit("\n"),
        F.lit("topics:\n  primary: "), primary, F.lit("\n  secondary: "), _yaml_list(F.col("topics.secondary")),
        F.lit("\n"), ents, F.lit("key_takeaways: "), _yaml_list(F.col("key_takeaways")), F.lit("\n"), extra)
    raw = F.when(k % 19 == 0, F.lit("I could not produce metadata for this article."))\
        .otherwise(F.concat(F.lit("Here is the record:\n```YAML\n"), body, F.lit("```\n")))
    return r.select("doc_id", "path", "attempt", raw.alias("raw"))
