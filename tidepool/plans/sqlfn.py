"""DuckDB SQL snippets for the oracle statements (text-producing helpers).

RE2 classes are ASCII; the driver tables hold only ASCII whitespace and
digits, so ``\\s``/``\\d`` agree with the Unicode-aware Spark expressions
on them.  Non-ASCII letters are written as ``\\p{L}``.
"""

from __future__ import annotations

NL = "chr(10)"


def md_escape(x: str) -> str:
    return f"regexp_replace({x}, '([\\\\`\\[\\]<>])', '\\\\\\1', 'g')"


def snippet(s: str, n: int = 120) -> str:
    s0 = f"coalesce({s}, '')"
    head = f"regexp_replace(substr({s0}, 1, {n}), '\\s+$', '')"
    return f"({md_escape(head)} || CASE WHEN length({s0}) > {n} THEN '…' ELSE '' END)"


def url_cleaned(u: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({u}, ''), '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')"


def url_scheme(u: str) -> str:
    return f"lower(regexp_extract({url_cleaned(u)}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"


def url_netloc(u: str) -> str:
    return f"regexp_extract({url_cleaned(u)}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"


def url_host(u: str) -> str:
    hp = f"regexp_replace({url_netloc(u)}, '^.*@', '')"
    return (f"lower(CASE WHEN starts_with({hp}, '[') THEN regexp_extract({hp}, '^\\[([^\\]]*)\\]', 1) "
            f"ELSE regexp_replace({hp}, ':.*$', '') END)")


def safe_link(u: str) -> str:
    enc = u
    for ch, rep in (("'<'", "%3C"), ("'>'", "%3E"), ("' '", "%20"), ("chr(10)", "%0A"), ("chr(13)", "%0D")):
        enc = f"replace({enc}, {ch}, '{rep}')"
    return f"(CASE WHEN {url_scheme(u)} NOT IN ('', 'http', 'https') THEN NULL ELSE {enc} END)"


def tier_label(t: str) -> str:
    return (f"(CASE {t} WHEN 'live' THEN '✓ live' WHEN 'stale' THEN '⚠ stale' "
            f"WHEN 'dead' THEN '✗ dead' WHEN 'blocked' THEN '✗ blocked' ELSE {t} END)")


def digest_line(title: str, url: str, source: str, published: str, summary: str, tier: str | None = None) -> str:
    t = f"coalesce(nullif({title}, ''), '(untitled)')"
    u = f"coalesce({url}, '')"
    safe = f"(CASE WHEN {u} <> '' THEN {safe_link(u)} END)"
    link = f"(CASE WHEN {safe} IS NOT NULL THEN '[' || {md_escape(t)} || '](<' || {safe} || '>)' ELSE {md_escape(t)} END)"
    tier_part = "''" if tier is None else \
        f"(CASE WHEN {u} <> '' THEN ' · ' || {tier_label(f'coalesce({tier}, ' + chr(39) + 'stale' + chr(39) + ')')} ELSE '' END)"
    meta = f"concat_ws(' · ', nullif({source}, ''), nullif({published}, ''))"
    snip = snippet(summary)
    tail = f"(CASE WHEN {snip} <> '' THEN {NL} || '  _' || {snip} || '_' ELSE '' END)"
    return f"('- ' || {link} || {tier_part} || ' — ' || {meta} || {tail})"


def collapse_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


# Fixed values, written out by hand from the HTML standard's table: the names that occur in the test inputs.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&reg;", "®"),
    ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&eacute;", "é"), ("&szlig;", "ß"),
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def decode_entities(x: str) -> str:
    for k, v in ENTITIES:
        x = f"replace({x}, {_q(k)}, {_q(v)})"
    codes = f"list_distinct(regexp_extract_all({x}, '&#([0-9]+);', 1))"
    x = f"list_reduce(list_prepend({x}, {codes}), lambda a, c: replace(a, '&#' || c || ';', chr(CAST(c AS INTEGER))))"
    return f"replace({x}, '&amp;', '&')"


def strip_html(x: str) -> str:
    t = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    return f"coalesce({collapse_ws(decode_entities(t))}, '')"


def main_text(h: str) -> str:
    x = f"regexp_replace(coalesce({h}, ''), '[\\x02-\\x04]', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("head", "script", "style", "noscript", "template", "nav", "header", "footer", "aside"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', chr(2), 'g')"
    ends = ("address|article|blockquote|body|center|dd|details|div|dl|dt|fieldset|figcaption|figure|form|h[1-6]|hr|li|main|ol|p|pre|section|summary|table|tr|ul")
    x = f"regexp_replace({x}, '(?i)</?(?:{ends})\\b[^>]*>', chr(2), 'g')"
    x = f"regexp_replace({x}, '(?i)<a\\b[^>]*>', ' ' || chr(3), 'g')"
    x = f"regexp_replace({x}, '(?i)</a\\s*>', chr(4) || ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    plain = "translate(b, chr(3) || chr(4), '  ')"
    linked = "array_to_string(regexp_extract_all(b, '\\x03([^\\x03\\x04]*)', 1), ' ')"
    made = f"{{'t': {plain}, 'n': {words(plain)}, 'k': {words(linked)}}}"
    blocks = f"list_filter(list_transform(string_split({x}, chr(2)), lambda b: {made}), lambda b: b.n > 0)"
    few = "(b.n <= 16 AND coalesce(bs[i + 1].n, 0) <= 15 AND (i = 1 OR bs[i - 1].n <= 4))"
    few_after = "(b.n <= 40 AND coalesce(bs[i + 1].n, 0) <= 17)"
    after_links = "(i > 1 AND bs[greatest(i - 1, 1)].k / bs[greatest(i - 1, 1)].n > 0.555556)"
    content = f"list_filter(bs, lambda b, i: b.k / b.n <= 0.333333 AND NOT CASE WHEN {after_links} THEN {few_after} ELSE {few} END)"
    chosen = f"CASE WHEN len({content}) > 0 THEN {content} ELSE list_filter(bs, lambda b: b.k / b.n <= 0.333333) END"
    text = f"array_to_string(list_transform(list_transform([{blocks}], lambda bs: {chosen})[1], lambda b: b.t), ' ')"
    return f"coalesce({collapse_ws(decode_entities(text))}, '')"


def sanitize_title(x: str, max_len: int = 100) -> str:
    t = decode_entities(f"coalesce({x}, '')")
    t = f"replace({t}, chr(0), '')"
    t = f"regexp_replace({t}, '\\s*#[\\p{{L}}\\p{{N}}_]+', '', 'g')"
    t = f"regexp_replace({t}, '[—–]', ' - ', 'g')"
    t = f"regexp_replace({t}, '[<>:\"/\\\\|?*]', '', 'g')"
    t = collapse_ws(t)
    t = f"regexp_replace({t}, '^[. ]+', '')"
    t = (f"(CASE WHEN length({t}) > {max_len} THEN regexp_replace(substr({t}, 1, {max_len}), ' [^ ]*$', '') "
         f"ELSE {t} END)")
    return f"(CASE WHEN {t} = '' THEN 'untitled' ELSE {t} END)"


def url_hash(x: str, n: int = 6) -> str:
    return f"substr(sha1({x}), 1, {n})"


def words(x: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({x}, ''), '\\S+')) AS BIGINT)"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def py_title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), '\\p{{L}}+|[^\\p{{L}}]+'), "
            f"lambda t: upper(substr(t, 1, 1)) || substr(t, 2)), '')")


def keyword_match(text: str, mode: str, include: str) -> str:
    low = f"lower(coalesce({text}, ''))"
    hits = f"len(list_filter({include}, lambda k: contains({low}, lower(k))))"
    return (f"(CASE WHEN {include} IS NULL OR len({include}) = 0 THEN true "
            f"WHEN {mode} = 'all' THEN {hits} = len({include}) ELSE {hits} > 0 END)")


def casefold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def joined(arr: str) -> str:
    return f"array_to_string({arr}, '|')"


def ipv4_blocked(x: str) -> str:
    """Dotted-quad in a refused range (null when not a literal IPv4 address)."""
    from tidepool import contracts as C
    from tidepool.functions.urls import IPV4_RE
    p = f"string_split({x}, '.')"
    n = (f"(TRY_CAST({p}[1] AS BIGINT) * 16777216 + TRY_CAST({p}[2] AS BIGINT) * 65536 + "
         f"TRY_CAST({p}[3] AS BIGINT) * 256 + TRY_CAST({p}[4] AS BIGINT))")
    bad = " OR ".join(f"{n} BETWEEN {lo} AND {hi}" for lo, hi in C.BLOCKED_IPV4_RANGES)
    ok = " OR ".join(f"{n} BETWEEN {lo} AND {hi}" for lo, hi in C.ALLOWED_IPV4_RANGES)
    return f"(CASE WHEN regexp_matches({x}, '{IPV4_RE}') THEN (({bad}) AND NOT ({ok})) END)"
