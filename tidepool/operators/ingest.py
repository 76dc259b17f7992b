"""Ingest (J1): adapters' items → registry → limit → filter → dedup → new documents.

Order matters and is kept: the per-source limit runs before the keyword
filter and dedup (a source may yield fewer than N new items), and the
anti-join against existing files runs before bodies are joined in, so only
new items ever touch the large fetched-body table.

Scale notes
-----------
* Registry: a source dimension; broadcast only after its row count is
  checked (:func:`checked_broadcast`), else a normal shuffle join.
* Per-source limit: a literal upper bound (the registry's largest limit)
  lets Spark plan WindowGroupLimit partial+final, so a hot source ships at
  most that many rows per map task; the exact per-source limit is applied
  after.
* First-wins dedup is an aggregation (``min_by`` on (source_ord, pos)) and
  combines map-side: a stem shared by a third of all rows is reduced before
  the shuffle instead of landing whole in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool import contracts as C
from tidepool.functions.dates import file_stem
from tidepool.functions.text import has_min_words, keyword_match, sanitize_title
from tidepool.functions.urls import url_hash
from tidepool.operators.bloom import bloom_of, might_hold, words_for
from tidepool.session import cut_lineage

BROADCAST_MAX_ROWS = 200_000


def checked_broadcast(dim: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only when the dimension is proven small (row count ≤ max_rows)."""
    n = dim.limit(max_rows + 1).count()
    return F.broadcast(dim) if n <= max_rows else dim


def union_adapters(*items: DataFrame) -> DataFrame:
    """All dialects in one item shape (missing columns become null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), items)


def first_across_adapters(*items: DataFrame) -> DataFrame:
    """One document per (namespace, stem) whichever adapter found it: the first by
    source order, then by the adapters' order here."""
    tagged = [i.withColumn("_adapter", F.lit(k)) for k, i in enumerate(items)]
    return first_wins_dedup(union_adapters(*tagged), order=("source_ord", "_adapter")).drop("_adapter")


def registry_stats(registry: DataFrame) -> dict:
    """Enabled-source count, largest and summed per-source limit — one small
    aggregation over the dimension, used for broadcast decisions and bounds.
    A missing limit counts as the default."""
    limit = F.coalesce(F.col("scrape_limit"), F.lit(C.DEFAULT_SCRAPE_LIMIT))
    r = registry.where(F.col("enabled")).agg(
        F.count(F.lit(1)).alias("n"), F.max(limit).alias("max_limit"), F.sum(limit).alias("sum_limit")).first()
    return {"n": int(r["n"] or 0), "max_limit": int(r["max_limit"] or C.DEFAULT_SCRAPE_LIMIT),
            "sum_limit": int(r["sum_limit"] or 0)}


def of_type(registry: DataFrame, *types: str) -> DataFrame:
    """The sources an adapter serves (a registry without ``type`` is taken whole)."""
    return registry.where(F.col("type").isin(*types)) if "type" in registry.columns else registry


def join_registry(items: DataFrame, registry: DataFrame, source_col: str = "source",
                  n_sources: int | None = None) -> DataFrame:
    """Each item carries its (enabled) source's settings; items of disabled or
    unknown sources drop out.  ``perspective`` defaults to '', a missing
    ``scrape_limit`` to the default limit.

    The registry is broadcast when its enabled row count (given, or counted
    here) is at most :data:`BROADCAST_MAX_ROWS`; otherwise a shuffle join.
    """
    reg = registry.where(F.col("enabled")).withColumnRenamed("name", source_col) \
        .withColumn("perspective", F.coalesce(F.col("perspective"), F.lit("")))
    if "scrape_limit" in reg.columns:
        reg = reg.withColumn("scrape_limit", F.coalesce(F.col("scrape_limit"), F.lit(C.DEFAULT_SCRAPE_LIMIT)))
    reg = reg.drop(*[c for c in reg.columns if c in items.columns and c != source_col])
    if n_sources is None:
        reg = checked_broadcast(reg)
    elif n_sources <= BROADCAST_MAX_ROWS:
        reg = F.broadcast(reg)
    return items.join(reg, source_col, "inner")


def restrict_to(big: DataFrame, small_keys: DataFrame, keys: list[str], bound: int | None) -> DataFrame:
    """Rows of ``big`` whose keys may occur in ``small_keys``: all that do, and a few chance hits.

    A Bloom filter of the keys is tested in the scan of ``big``, which is never
    shuffled whole, however many keys there are; the caller's join then decides.
    ``bound`` (an upper bound on ``small_keys`` rows) sizes the filter.
    """
    words = words_for(bound)
    return might_hold(big, bloom_of(small_keys, keys, words), keys, words)


def limit_per_source(items: DataFrame, limit_col: str = "scrape_limit", part_col: str = "source",
                     order_col: str = "pos", max_limit: int | None = None) -> DataFrame:
    """First ``limit`` items per source in feed order; a null limit is the default one.

    ``max_limit`` (a literal ≥ every per-source limit, see
    :func:`registry_stats`) enables the WindowGroupLimit pre-filter; when
    omitted it is the largest limit among the items (one more pass over them).
    """
    limit = F.coalesce(F.col(limit_col), F.lit(C.DEFAULT_SCRAPE_LIMIT))
    if max_limit is None:
        max_limit = items.agg(F.max(limit)).first()[0] or 0
    w = Window.partitionBy(part_col).orderBy(order_col)
    pre = items.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.lit(int(max_limit)))
    return pre.where(F.col("_rn") <= limit).drop("_rn")


def registry_max_limit(registry: DataFrame) -> int:
    """Largest per-source limit (one value aggregated from the small registry)."""
    return int(registry.agg(F.max(F.coalesce(F.col("scrape_limit"), F.lit(C.DEFAULT_SCRAPE_LIMIT)))).first()[0] or C.DEFAULT_SCRAPE_LIMIT)


def keyword_filter(items: DataFrame, text: Column, mode_col: str = "kf_mode", include_col: str = "kf_include") -> DataFrame:
    return items.where(keyword_match(text, F.col(mode_col), F.col(include_col)))


def feed_filter_text() -> Column:
    """Feed entries are filtered on title + ' ' + description."""
    return F.concat_ws(" ", F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("description"), F.lit("")))


def dedup_id(link: Column, entry_id: Column, title: Column, description: Column) -> Column:
    """link, else id/guid, else title + '\\n' + description."""
    return F.coalesce(F.nullif(link, F.lit("")), F.nullif(entry_id, F.lit("")),
                      F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit(""))))


def stem(title: Column, ident: Column) -> Column:
    """Sanitised title + '-' + first 6 hex of SHA-1(ident) (no suffix for an empty ident)."""
    clean = sanitize_title(title)
    return F.when(F.coalesce(ident, F.lit("")) != "", F.concat(clean, F.lit("-"), url_hash(ident))).otherwise(clean)


def dedup_key(items: DataFrame) -> DataFrame:
    ident = dedup_id(F.col("link"), F.col("entry_id"), F.col("title"), F.col("description"))
    return items.withColumn("dedup_id", ident).withColumn("stem", stem(F.col("title"), ident))


def first_wins_dedup(items: DataFrame, keys=("namespace", "stem"), order=("source_ord", "pos")) -> DataFrame:
    """One row per key: the first by (source order, feed position).

    Expressed as ``min_by`` so the reduction is partial (map-side) and a hot
    key never gathers in one task.
    """
    cols = [c for c in items.columns if c not in keys]
    agg = items.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_w"))
    return agg.select(*keys, *[F.col("_w")[c].alias(c) for c in cols])


def anti_join_seen(items: DataFrame, seen: DataFrame, keys=("namespace",), bound: int | None = None) -> DataFrame:
    """Drop items whose stem already exists as a file in the namespace, any date.

    The (large, ever-growing) seen table is first cut to the candidate stems by
    a Bloom filter; ``bound`` is an upper bound on the item count.
    """
    existing = seen.select(*keys, file_stem(F.col("file_name")).alias("stem"))
    existing = restrict_to(existing, items, [*keys, "stem"], bound).distinct()
    return items.join(existing, [*keys, "stem"], "left_anti")


def full_body_join(items: DataFrame, fetched: DataFrame, min_words: int = C.MIN_BODY_WORDS_FETCH,
                   bound: int | None = None) -> DataFrame:
    """When the source wants full content and the item has a link, a fetched body
    with ≥ ``min_words`` words replaces the excerpt (``content_from`` says which).

    ``fetched`` holds one body per url (the output of a fetch job keyed by
    url).  Only the bodies of the items' links pass the scan (Bloom filter,
    sized by ``bound``); the body table is never shuffled whole.
    """
    f = fetched.where(F.col("url") != "").select(F.col("url").alias("link"), F.col("body").alias("_fetched"))
    f = restrict_to(f, items.where(F.coalesce(F.col("link"), F.lit("")) != ""), ["link"], bound)
    wants = F.coalesce(F.col("scrape_full_content"), F.lit(False)) & (F.coalesce(F.col("link"), F.lit("")) != "")
    j = items.join(f, "link", "left")
    use = wants & F.col("_fetched").isNotNull() & has_min_words(F.col("_fetched"), min_words)
    return (j.withColumn("content", F.when(use, F.col("_fetched")).otherwise(F.col("content")))
             .withColumn("content_from", F.when(use, F.lit("fetched")).otherwise(F.lit("excerpt")))
             .drop("_fetched"))


def new_documents(items: DataFrame) -> DataFrame:
    """Render the document text and file name of each new item."""
    from tidepool.sources.sinks import file_name, render_document
    return (items.withColumn("file_name", file_name(F.col("date"), F.col("stem")))
            .withColumn("doc_text", render_document(F.col("title"), F.col("source"), F.col("link"), F.col("date"),
                                                    F.col("tags"), F.col("perspective"), F.col("content"))))


def ingest_feed_items(entries_raw: DataFrame, registry: DataFrame, seen: DataFrame, fetched: DataFrame,
                      run_date: str = C.RUN_DATE) -> DataFrame:
    """The RSS/Atom adapter as one plan: registry → limit → text/date cleaning →
    keyword filter → dedup key → first wins → anti-join seen → full body →
    rendered documents.

    ``entries_raw`` comes from :func:`tidepool.sources.scans.scan_feed_raw`;
    cleaning runs after the per-source limit, so only kept entries pay for it.
    After the limit at most Σ(per-source limits) rows remain — a bound known
    from the registry — and the large seen/body tables are cut by Bloom
    filters of that size instead of being shuffled.  The limited rows are checkpointed
    so the scan below them runs once.
    """
    from tidepool.sources.scans import finish_entries
    registry = of_type(registry, "rss")
    stats = registry_stats(registry)
    j = join_registry(entries_raw, registry, n_sources=stats["n"]).withColumn("namespace", F.col("output_dir"))
    # ≤ Σ(limits) rows from here on: freeze them once so the scan is not
    # recomputed by each of the joins below (reliable checkpoint, shared dir).
    limited = finish_entries(cut_lineage(limit_per_source(j, max_limit=stats["max_limit"])), run_date)
    filtered = keyword_filter(limited, feed_filter_text())
    keyed = dedup_key(filtered)
    firsts = first_wins_dedup(keyed)
    new = anti_join_seen(firsts, seen, bound=stats["sum_limit"])
    bodies = full_body_join(new, fetched, bound=stats["sum_limit"])
    return new_documents(bodies)


# ---------------------------------------------------------------------------
# Listing pages and video listings
# ---------------------------------------------------------------------------

def ingest_listing_items(pages: DataFrame, registry: DataFrame, seen: DataFrame, fetched: DataFrame,
                         run_date: str = C.RUN_DATE) -> DataFrame:
    """Listing adapter: distinct links (first occurrence order) → first N per
    source → slug keyword filter → fetched article (≥ 100 words, else dropped) →
    title from the body's first heading / URL slug → date found in the text →
    keyword filter on title + first 1000 chars → stem (title + hash of the
    full URL) → first wins → anti-join seen.

    Each page is cut to N links in its row; a source's pages then share one
    limit.  At most Σ(per-source limits) links remain: they are checkpointed,
    and the body and seen tables are cut to them by Bloom filters before they are joined.
    """
    from tidepool.functions.text import date_in_text, slug_text, title_from_body
    from tidepool.functions.urls import resolve_link
    registry = of_type(registry, "listing")
    stats = registry_stats(registry)
    j = join_registry(pages, registry, n_sources=stats["n"]).withColumn("namespace", F.col("output_dir"))
    pattern = F.coalesce(F.col("listing_link_pattern"), F.lit(C.DEFAULT_LISTING_LINK_PATTERN))
    links = F.slice(F.array_distinct(F.regexp_extract_all(F.col("html"), pattern, 1)), 1, F.col("scrape_limit"))
    ex = j.select("*", F.posexplode(links).alias("link_pos", "link")).drop("html")
    ex = ex.withColumn("pos", F.struct("page_id", "link_pos"))
    ex = cut_lineage(limit_per_source(first_wins_dedup(ex, keys=("source", "link"), order=("pos",)), max_limit=stats["max_limit"]))
    ex = ex.withColumn("url", resolve_link(F.col("feed_url"), F.col("link")))
    ex = ex.where(keyword_match(slug_text(F.col("link")), F.col("kf_mode"), F.col("kf_include")))
    f = fetched.where(F.col("url") != "").select("url", F.col("body").alias("content"))
    f = restrict_to(f, ex, ["url"], stats["sum_limit"])
    body = ex.join(f, "url", "inner").where(has_min_words(F.col("content"), min_words_default()))
    body = body.withColumn("title", title_from_body(F.col("content"), F.col("url"))) \
        .withColumn("date", date_in_text(F.col("content"), run_date))
    text2 = F.concat_ws(" ", F.col("title"), F.substring(F.col("content"), 1, 1000))
    kept = body.where(keyword_match(text2, F.col("kf_mode"), F.col("kf_include")))
    kept = kept.withColumn("stem", stem(F.col("title"), F.col("url")))
    firsts = first_wins_dedup(kept)
    new = anti_join_seen(firsts, seen, bound=stats["sum_limit"])
    return new.withColumn("link", F.col("url")).transform(new_documents)


def min_words_default() -> int:
    return C.MIN_BODY_WORDS_FETCH


def ingest_video_items(lines: DataFrame, segments: DataFrame, registry: DataFrame, seen: DataFrame,
                       run_date: str = C.RUN_DATE) -> DataFrame:
    """Video adapter: listing lines → first N videos per source (listing order)
    → transcript of the preferred track (blank ones dropped) → keyword filter
    on title + transcript → stem (title + hash of the URL) → first wins →
    anti-join seen.  The document date is the upload date.

    The limited videos (≤ Σ limits) are checkpointed, and only their segments
    are grouped into transcripts."""
    from tidepool.operators.transcripts import video_transcripts
    from tidepool.sources.scans import scan_captions
    registry = of_type(registry, "youtube")
    stats = registry_stats(registry)
    vids = scan_captions(lines, run_date=run_date)
    j = join_registry(vids, registry, n_sources=stats["n"]).withColumn("namespace", F.col("output_dir"))
    limited = cut_lineage(limit_per_source(j, order_col="line_no", max_limit=stats["max_limit"]))
    own = segments.withColumn("_id", F.concat(F.lit("v"), F.col("video").cast("string")))
    own = restrict_to(own, limited.select(F.col("id").alias("_id")), ["_id"], stats["sum_limit"]).drop("_id")
    tr = video_transcripts(own).select(F.concat(F.lit("v"), F.col("video").cast("string")).alias("id"),
                                            F.col("transcript").alias("content"))
    items = limited.join(tr, "id", "inner")
    items = items.where(keyword_match(F.concat_ws(" ", F.col("title"), F.col("content")),
                                      F.col("kf_mode"), F.col("kf_include")))
    items = (items.withColumn("stem", stem(F.col("title"), F.col("url")))
             .withColumn("pos", F.col("line_no")).withColumn("date", F.col("upload_date"))
             .withColumn("link", F.col("url")))
    firsts = first_wins_dedup(items)
    return new_documents(anti_join_seen(firsts, seen, bound=stats["sum_limit"]))
