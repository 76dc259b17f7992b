"""Link audit: URL guard, status tiers, verification join, distinct URLs.

Live probing is re-aimed as tables: a checks table (url, status) stands for
HEAD responses and a host→ip table stands for name resolution.  An
unresolvable host is refused (fail closed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool import contracts as C
from tidepool.functions.urls import hostname, ip_blocked, is_literal_ip, scheme


def status_tier(status: Column, blocked: Column | None = None) -> Column:
    """404/410 dead; 200–399 live; anything else or no response stale; guard failure blocked."""
    tier = (F.when(status.isin(*C.DEAD_STATUS), "dead")
             .when((status >= 200) & (status < 400), "live").otherwise("stale"))
    return tier if blocked is None else F.when(blocked, "blocked").otherwise(tier)


def resolve_hosts(dns: DataFrame) -> DataFrame:
    """(host, ip) rows → one row per host: address count and whether any is refused.

    A partial aggregation: a host with many addresses is combined map-side.
    """
    return dns.groupBy(F.lower(F.col("host")).alias("host")).agg(
        F.count("ip").alias("n_ips"),
        F.max(ip_blocked(F.col("ip")).cast("int")).alias("any_blocked"))


def host_verdicts(hosts: DataFrame, dns: DataFrame) -> DataFrame:
    """(host, scheme) → guard_reason (null = allowed), one row per distinct pair.

    Literal IPs are judged directly (IPv6 through Python, only for hosts with
    ':'); names through the host→ip table, unresolvable names are refused.
    """
    j = hosts.join(resolve_hosts(dns), "host", "left")
    h = F.col("host")
    literal = is_literal_ip(h)
    literal_blocked = ip_blocked(F.when(literal, h))
    reason = (F.when(~F.col("_scheme").isin("http", "https"), F.lit("scheme"))
               .when(h == "", F.lit("empty_host"))
               .when(h.isin(*C.METADATA_HOSTS), F.lit("metadata_host"))
               .when(literal & literal_blocked.isNotNull(),
                     F.when(literal_blocked, F.lit("private_ip")))
               .when(F.col("n_ips").isNull() | (F.col("n_ips") == 0), F.lit("unresolved"))
               .when(F.col("any_blocked") == 1, F.lit("private_ip")))
    return j.select("host", "_scheme", reason.alias("guard_reason"))


def url_guard(df: DataFrame, dns: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host``, ``guard_reason`` (null when allowed) and ``blocked``.

    Reasons: scheme, empty_host, metadata_host, private_ip, unresolved.  The
    verdict is computed once per distinct (host, scheme) — a partial
    aggregation — and joined back, so the per-URL work stays native.
    """
    url = F.col(url_col)
    with_host = df.withColumn("host", hostname(url)).withColumn("_scheme", scheme(url))
    verdicts = host_verdicts(with_host.select("host", "_scheme").distinct(), dns)
    j = with_host.join(verdicts, ["host", "_scheme"], "left")
    return j.withColumn("blocked", F.col("guard_reason").isNotNull()).drop("_scheme")


def check_tiers(checks: DataFrame, dns: DataFrame) -> DataFrame:
    """checks (url, status) → (url, tier): guard first, then the status tier."""
    g = url_guard(checks, dns)
    return g.withColumn("tier", status_tier(F.col("status"), F.col("blocked")))


def verification_join(entries: DataFrame, tiers: DataFrame, entries_bound: int | None = None) -> DataFrame:
    """Entry → tier by url; unknown url → 'stale'; empty url → no tier (null).

    Of several checks of a url a guard failure always wins; else the latest
    counts (column ``checked_at``, if there is one), and on equal times the
    worse tier: the label fails closed.

    The tiers table is first cut to the entries' urls by a Bloom filter, so the
    large side is scanned once and never shuffled whole; ``entries_bound`` (an
    upper bound on the entries, e.g. the window limit) sizes the filter.
    """
    from tidepool.operators.ingest import restrict_to
    urls = entries.select(F.col("url")).where(F.col("url") != "")
    at = F.col("checked_at") if "checked_at" in tiers.columns else F.lit(None).cast("timestamp")
    severity = F.array_position(F.array(*[F.lit(t) for t in ("live", "stale", "dead", "blocked")]), F.col("tier"))
    needed = restrict_to(tiers.select("url", "tier", at.alias("_at"), severity.alias("_severity")), urls, ["url"], entries_bound)
    needed = needed.groupBy("url").agg(F.max_by("tier", F.struct(F.col("tier") == "blocked", "_at", "_severity")).alias("tier"))
    j = entries.join(needed, "url", "left")
    return j.withColumn("tier", F.when(F.coalesce(F.col("url"), F.lit("")) != "",
                                       F.coalesce(F.col("tier"), F.lit("stale"))))


def distinct_urls(entries: DataFrame, order_col: str = "pos") -> DataFrame:
    """Distinct non-empty URLs with their first position (ordered by it)."""
    return (entries.where(F.coalesce(F.col("url"), F.lit("")) != "")
            .groupBy("url").agg(F.min(order_col).alias("first_pos")))
