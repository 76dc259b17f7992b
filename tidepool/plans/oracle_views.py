"""DuckDB twins of the fixture views in :mod:`tidepool.plans.fixtures`.

Used only to build the oracle SQL strings (each query is prefixed with the
CTEs it needs).  Plain ANSI SQL plus DuckDB list/regex functions.
"""

from __future__ import annotations

NL = "chr(10)"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql)


view("v_items", (), f"""
SELECT doc_id, doc_id AS pos, source, lang,
       CASE WHEN doc_id % 9 = 0 THEN 'Caf&eacute; &#8217;24 &amp;lt; ' ELSE '' END || substr(text, 1, 150) AS title,
       text AS description, text AS content,
       CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'https://' || source || '.example.com/' || lang || '/' || CAST(doc_id AS VARCHAR) END AS link,
       CASE WHEN doc_id % 22 = 0 THEN '' ELSE 'g' || CAST(doc_id AS VARCHAR) END AS guid,
       strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER), '%Y-%m-%d') AS published,
       source AS namespace, n_chars
FROM documents""")

view("v_docs", ("v_items",), """
SELECT i.*, i.source || '/' || lpad(CAST(i.doc_id AS VARCHAR), 8, '0') || '.md' AS path,
       l.quality, l.toxic, (l.quality = 1) AS enriched
FROM v_items i LEFT JOIN labels l ON i.doc_id = l.doc_id""")

view("v_index", ("v_docs",), """
SELECT doc_id, path, title, source, link AS url,
       CASE WHEN doc_id % 13 = 0 THEN '' ELSE published END AS published,
       ['feed', lang] AS tags,
       CASE WHEN doc_id % 7 = 0 THEN []::VARCHAR[] WHEN doc_id % 3 = 0 THEN [lang, 'long'] ELSE [lang] END AS primary_topics,
       CASE WHEN toxic = 1 THEN ['flagged'] ELSE []::VARCHAR[] END AS secondary_topics,
       content AS summary, 'organizations=' || lang || ',' || source || ';venues=' || source AS entities, enriched
FROM v_docs WHERE enriched""")

view("v_article", ("v_items",), f"""
SELECT doc_id, source,
       'https://' || source || '.example.com/posts/' || lang || '-report_' || CAST(doc_id AS VARCHAR) AS url,
       CASE WHEN doc_id % 2 = 0 THEN '# ' || title || {NL} || {NL} || published || {NL} || {NL} || content
            ELSE content END AS body
FROM v_items""")

view("v_listing", ("v_items",), """
SELECT doc_id AS page_id, source, 'https://' || source || '.example.com/blog/' AS feed_url,
       '<html><body><nav><a href="/login">Log in</a> <a href="/signup">Sign up</a></nav><h2><a href="/posts/' || lang
       || '-report_' || CAST(doc_id AS VARCHAR) || '">' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
       || '</a></h2><p><a href="/posts/' || lang || '-report_' || CAST(doc_id AS VARCHAR)
       || '">more</a> · <a href="/feed.xml">feed</a></p></body></html>' AS html
FROM v_items""")

view("v_registry", (), """
SELECT source AS name, n AS source_ord,
       CASE WHEN n % 5 = 3 THEN 'youtube' WHEN n % 5 = 4 THEN 'listing' ELSE 'rss' END AS type,
       'https://' || source || '.example.com/feed' AS feed_url, 'ns' || CAST(n % 4 AS VARCHAR) AS output_dir,
       ['feed', 't' || CAST(n % 3 AS VARCHAR)] AS tags,
       CASE WHEN n % 4 = 0 THEN NULL ELSE 'p' || CAST(n AS VARCHAR) END AS perspective,
       10 + (n % 7) * 3 AS scrape_limit, (n % 2 = 0) AS scrape_full_content,
       'g' || CAST(n % 3 AS VARCHAR) AS throttle_group,
       CASE WHEN n % 2 = 0 THEN 10.0 ELSE 0.0 END AS throttle_seconds,
       CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN 'any' WHEN 2 THEN 'all' ELSE 'some' END AS kf_mode,
       CASE n % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['The', 'le', 'der'] WHEN 2 THEN ['e', 'a']
            ELSE ['que', 'ING'] END AS kf_include,
       (n % 10 <> 9) AS enabled
FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS n FROM documents)""")

view("v_dedup", (), """
SELECT pos, source, key_id, description, 'Report ' || CAST(key_id AS VARCHAR) AS title,
       CASE WHEN key_id % 11 = 0 THEN '' ELSE 'https://f.example.com/' || CAST(key_id AS VARCHAR) END AS link,
       CASE WHEN key_id % 22 = 0 THEN '' ELSE 'g' || CAST(key_id AS VARCHAR) END AS guid,
       'ns' || CAST(key_id % 4 AS VARCHAR) AS namespace
FROM (SELECT doc_id AS pos, source,
             CASE WHEN doc_id % 10 < 2 THEN doc_id - doc_id % 2 ELSE doc_id END AS key_id,
             text AS description FROM documents)""")

view("v_seen", ("v_dedup",), f"""
SELECT DISTINCT namespace,
       '2023-12-31 - ' || title || '-' ||
       substr(sha1(coalesce(nullif(link, ''), nullif(guid, ''), title || {NL} || description)), 1, 6) || '.md' AS file_name
FROM v_dedup WHERE key_id % 6 = 0""")

view("v_conv", (), """
SELECT conv_id AS video, turn AS seq, text AS segment,
       CASE WHEN role = 'assistant' THEN 'manual_en' WHEN role = 'user' THEN 'generated_en' ELSE 'other' END AS track
FROM conversations""")

view("v_events", (), """
SELECT event_id, CASE WHEN event_id % 8 <> 5 THEN user_id END AS throttle_group, epoch_us(ts) AS ts_us,
       epoch_us(ts) + CAST(floor(value * 1000000 + 0.5) AS BIGINT) AS end_us,
       CAST(3600000000 AS BIGINT) AS throttle_us, user_id, event_type
FROM events""")

view("v_checks", (), """
SELECT event_id, ts, 'https://h' || CAST(user_id AS VARCHAR) || '.example.com/' || CAST(event_id AS VARCHAR) AS url,
       CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 301 WHEN 'purchase' THEN 404
                       WHEN 'signup' THEN 503 END AS status,
       CAST(user_id AS VARCHAR) AS source
FROM events""")

view("v_usage", (), """
SELECT conv_id, turn, role AS model, CAST(length(text) AS BIGINT) AS input_tokens, turn AS cache_read,
       CAST(NULL AS BIGINT) AS cache_creation, CAST(length(text) // 4 AS BIGINT) AS output_tokens
FROM conversations""")

view("v_entities", (), """
SELECT doc_id, pos, CASE WHEN pos % 2 = 1 THEN replace(upper(tok), 'ẞ', 'SS') ELSE tok END AS token
FROM (SELECT doc_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS tok
      FROM (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS toks FROM documents))""")

view("v_rec", ("v_docs",), """
SELECT doc_id, path, attempt, k, ((k % 17) <> 0) AS enriched,
       CASE WHEN k % 5 = 0 THEN substr(content, 1, 50) ELSE content END AS summary,
       CASE WHEN k % 7 = 0 THEN [lang, 'offtopic'] ELSE [lang] END AS primary_topics,
       CASE WHEN n_chars > 2000 THEN ['long'] ELSE []::VARCHAR[] END AS secondary_topics,
       (k % 11 = 0) AS entities_missing,
       CASE WHEN k % 11 = 0 THEN NULL ELSE list_filter(string_split(content, ' '), lambda w: regexp_matches(w, '^[A-Z]')) END AS organizations,
       CASE WHEN k % 11 = 0 THEN NULL ELSE list_filter(string_split(content, ' '), lambda w: length(w) > 14) END AS people,
       CASE WHEN k % 13 = 0 THEN list_transform(range(1, 10), lambda x: 'point ' || CAST(x AS VARCHAR))
            ELSE ['point 1', 'point 2'] END AS key_takeaways
FROM (SELECT d.*, a.attempt, d.doc_id + a.attempt AS k
      FROM v_docs d, (SELECT unnest([1, 2, 3]) AS attempt) a)""")


def host_ips_sql(hosts_sql: str) -> str:
    """Name-resolution rows for the hosts produced by ``hosts_sql`` (column ``host``)."""
    return f"""
SELECT host, ip FROM (
  SELECT host, unnest([
    CASE WHEN length(host) % 6 = 0 THEN '127.0.0.1'
         WHEN length(host) % 6 = 1 THEN '192.168.1.' || CAST(length(host) AS VARCHAR)
         WHEN length(host) % 6 = 3 THEN '169.254.169.254'
         WHEN length(host) % 6 = 2 THEN NULL
         ELSE '93.184.216.' || CAST(length(host) AS VARCHAR) END,
    CASE WHEN length(host) % 6 = 4 THEN '10.0.0.' || CAST(length(host) AS VARCHAR) END]) AS ip
  FROM ({hosts_sql})) WHERE ip IS NOT NULL"""


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding ``names`` and their dependencies, then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({VIEWS[n][1]}\n)" for n in order]
    ctes += [f"{k} AS ({v}\n)" for k, v in (extra or {}).items()]
    if not ctes:
        return body
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + stripped[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
