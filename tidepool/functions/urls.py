"""URL column expressions: hashing, scheme/host parsing, guards and joins.

Parsing follows Python's ``urllib.parse`` rules where they differ from
Spark's ``parse_url``: hosts with underscores are accepted, IPv6 brackets are
removed, leading C0/space characters and inner tab/CR/LF are ignored when the
scheme is read.
"""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool import contracts as C
from tidepool.functions.text import let

_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_IPV4_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_RE = rf"^{_IPV4_OCTET}\.{_IPV4_OCTET}\.{_IPV4_OCTET}\.{_IPV4_OCTET}$"


def url_hash(c: Column, length: int = C.URL_HASH_LEN) -> Column:
    """First ``length`` hex digits of SHA-1 of the UTF-8 text."""
    return F.substring(F.sha1(F.encode(c, "UTF-8")), 1, length)


def _cleaned(url: Column) -> Column:
    """Leading C0 controls/spaces removed, inner tab/CR/LF removed."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def scheme(url: Column) -> Column:
    """Lower-cased scheme, '' when there is none."""
    return F.lower(F.regexp_extract(_cleaned(F.coalesce(url, F.lit(""))), _SCHEME_RE, 1))


def netloc(url: Column) -> Column:
    """The authority part after ``scheme://`` (userinfo and port included)."""
    return F.regexp_extract(_cleaned(F.coalesce(url, F.lit(""))),
                            r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def hostname(url: Column) -> Column:
    """``urlparse(url).hostname`` or '' — lower-cased, no userinfo/port/brackets."""
    hostport = F.regexp_replace(netloc(url), r"^.*@", "")
    bracketed = F.regexp_extract(hostport, r"^\[([^\]]*)\]", 1)
    plain = F.regexp_replace(hostport, r":.*$", "")
    return F.lower(F.when(hostport.startswith("["), bracketed).otherwise(plain))


def safe_link(url: Column) -> Column:
    """Null for non-http(s) schemes; otherwise ``< > space LF CR`` percent-encoded.

    Scheme-relative and relative URLs pass.
    """
    s = scheme(url)
    encoded = url
    for ch, rep in (("<", "%3C"), (">", "%3E"), (" ", "%20"), ("\n", "%0A"), ("\r", "%0D")):
        encoded = F.replace(encoded, F.lit(ch), F.lit(rep))
    return F.when((s != "") & ~s.isin("http", "https"), F.lit(None).cast("string")).otherwise(encoded)


def ipv4_number(host: Column) -> Column:
    """Dotted-quad → bigint, null when the host is not a literal IPv4 address."""
    parts = F.split(host, r"\.")
    num = F.lit(0).cast("bigint")
    for i, shift in enumerate((24, 16, 8, 0)):
        num = num + F.shiftleft(F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint"), shift)
    return F.when(host.rlike(IPV4_RE), num)


def _in_ranges(num: Column, ranges) -> Column:
    cond = F.lit(False)
    for lo, hi in ranges:
        cond = cond | num.between(lo, hi)
    return cond


def ipv4_blocked(num: Column) -> Column:
    """Private, loopback, link-local, reserved or multicast (null-safe: null → False)."""
    return F.coalesce(_in_ranges(num, C.BLOCKED_IPV4_RANGES) & ~_in_ranges(num, C.ALLOWED_IPV4_RANGES),
                      F.lit(False))


def _ip_blocked_py(text: str | None):
    if text is None:
        return None
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    return bool(ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast)


@F.pandas_udf(T.BooleanType())
def ip_blocked_any(s: pd.Series) -> pd.Series:
    """Literal IP (v4 or v6) → blocked?; null when not an IP. Arrow-batched."""
    return s.map(_ip_blocked_py)


# IPv6 ranges refused by the guard, taken from the standard library's own
# network tables at import time (private minus its exceptions, loopback,
# link-local, reserved, multicast) as 32-digit hex bounds: fixed-width
# lower-case hex strings compare like the 128-bit numbers they spell.
def _v6_bounds(nets):
    out = []
    for n in nets:
        net = ipaddress.ip_network(n)
        out.append((f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"))
    return tuple(out)


_V6 = ipaddress._IPv6Constants  # noqa: SLF001 — the stdlib's published tables
V6_PRIVATE = _v6_bounds(_V6._private_networks)
V6_PRIVATE_EXCEPT = _v6_bounds(_V6._private_networks_exceptions)
V6_OTHER = _v6_bounds([*_V6._reserved_networks, _V6._multicast_network, _V6._linklocal_network, "::1/128"])
V6_MAPPED_PREFIX = "0" * 20 + "ffff"

_HEX_GROUP = r"[0-9a-f]{1,4}"
_V6_FULL = rf"^({_HEX_GROUP}:){{7}}{_HEX_GROUP}$"
_V6_COMPRESSED = rf"^(({_HEX_GROUP}:)*{_HEX_GROUP})?::(({_HEX_GROUP}:)*{_HEX_GROUP})?$"


def _expand_v6(h: Column) -> Column:
    """Hex-only IPv6 text (no zone, no dotted tail) → 8 groups, null if invalid."""
    empty = F.array().cast("array<string>")

    def with_parts(lg, rg):
        missing = F.lit(8) - F.size(lg) - F.size(rg)
        compressed = F.concat(lg, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), rg)
        return (F.when(h.rlike(_V6_FULL), F.split(h, ":"))
                 .when(h.rlike(_V6_COMPRESSED) & (missing >= 1), compressed))
    left = F.substring_index(h, "::", 1)
    right = F.substring_index(h, "::", -1)
    return let(F.when(left == "", empty).otherwise(F.split(left, ":")), lambda lg: let(
        F.when(right == "", empty).otherwise(F.split(right, ":")), lambda rg: with_parts(lg, rg)))


def ipv6_hex(host: Column) -> Column:
    """IPv6 text → 32 lower-case hex digits, null when not a valid address.

    Accepts the forms Python's ``ipaddress`` accepts: full, ``::``-compressed
    (standing for at least one group), an embedded dotted IPv4 tail, and a
    ``%zone`` suffix (ignored).
    """
    def with_tail(h0):
        def with_v4(tail):
            def with_num(num):
                v4_hex = F.lpad(F.lower(F.hex(num)), 8, "0")
                return F.when(tail == "", h0).when(num.isNotNull(), F.concat(
                    F.regexp_replace(h0, r"[0-9.]+$", ""), F.substring(v4_hex, 1, 4), F.lit(":"),
                    F.substring(v4_hex, 5, 4)))
            return let(ipv4_number(tail), with_num)
        return let(F.regexp_extract(h0, r":([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1), with_v4)
    h = let(F.regexp_replace(F.lower(host), r"%.*$", ""), with_tail)
    groups = let(h, _expand_v6)
    return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")


def _in_hex(hx: Column, bounds) -> Column:
    """``hx`` inside any (lo, hi) range: one check over a constant array."""
    ranges = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in bounds])
    return F.exists(ranges, lambda r: (hx >= r["lo"]) & (hx <= r["hi"]))


def ipv6_blocked(hx: Column) -> Column:
    """Blocked per the stdlib rules; an IPv4-mapped address is always reserved."""
    def check(x):
        private = _in_hex(x, V6_PRIVATE) & ~_in_hex(x, V6_PRIVATE_EXCEPT)
        return F.when(x.startswith(V6_MAPPED_PREFIX), F.lit(True)).otherwise(private | _in_hex(x, V6_OTHER))
    return let(hx, check)


def ip_blocked(host: Column) -> Column:
    """Literal IPv4 or IPv6 address → refused?; null when ``host`` is not one.
    Entirely native (no Python worker)."""
    def check(h):
        v4 = ipv4_number(h)
        return let(v4, lambda n: F.when(n.isNotNull(), ipv4_blocked(n)).otherwise(
            let(ipv6_hex(h), lambda x: F.when(x.isNotNull() & (x != ""), ipv6_blocked(x)))))
    return let(host, check)


def is_literal_ip(host: Column) -> Column:
    return host.rlike(IPV4_RE) | F.contains(host, F.lit(":"))


def host_allowed(url: Column, hosts=C.VIDEO_HOSTS) -> Column:
    """https and the exact netloc (port/userinfo included) in the allowed host set."""
    return (scheme(url) == "https") & F.lower(netloc(url)).isin(*hosts)


def tracker_host(url: Column, trackers=C.TRACKER_HOSTS) -> Column:
    """Host part (text between '//' and the next '/') contains a tracker name."""
    host = F.when(F.contains(url, F.lit("://")),
                  F.coalesce(F.try_element_at(F.split(url, "/"), F.lit(3)), F.lit(""))).otherwise(F.lit(""))
    arr = F.array(*[F.lit(t) for t in trackers])
    return F.exists(arr, lambda t: F.contains(host, t))


def request_dropped(url: Column, resource_type: Column) -> Column:
    return resource_type.isin(*C.BLOCKED_RESOURCE_TYPES) | tracker_host(url)


# Schemes whose URLs resolve relative references.
USES_RELATIVE = ("", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
                 "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss")


@F.pandas_udf(T.StringType())
def urljoin_udf(base: pd.Series, link: pd.Series) -> pd.Series:
    """Python's ``urljoin`` (reference implementation for tests)."""
    return pd.Series([None if (b is None or l is None) else urljoin(b, l) for b, l in zip(base, link)])


def _split_ref(u: Column):
    """(path, query or null, fragment or null) of a reference without scheme/authority."""
    frag = F.when(F.contains(u, F.lit("#")), F.regexp_extract(u, r"#(.*)$", 1))
    no_frag = F.regexp_replace(u, r"#.*$", "")
    query = F.when(F.contains(no_frag, F.lit("?")), F.regexp_extract(no_frag, r"\?(.*)$", 1))
    path = F.regexp_replace(no_frag, r"\?.*$", "")
    return path, query, frag


def _resolve_path(base_path: Column, path: Column) -> Column:
    """Merge and remove dot segments the way ``urljoin`` does."""
    empty = F.array().cast("array<string>")

    def merged(bp):
        base_dir = F.when(F.element_at(bp, -1) != "", F.slice(bp, 1, F.size(bp) - 1)).otherwise(bp)
        return let(F.concat(base_dir, F.split(path, "/")), lambda raw: F.when(
            F.size(raw) >= 2, F.concat(F.slice(raw, 1, 1),
                                       F.filter(F.slice(raw, 2, F.greatest(F.size(raw) - 2, F.lit(0))),
                                                lambda x: x != ""),
                                       F.slice(raw, -1, 1))).otherwise(raw))

    segs = F.when(path.startswith("/"), F.split(path, "/")).otherwise(let(F.split(base_path, "/"), merged))

    def resolve(sg):
        out = F.aggregate(sg, empty, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1,
                                                                                                F.lit(0))))
                          .when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
        out = F.when(F.element_at(sg, -1).isin(".", ".."), F.concat(out, F.array(F.lit("")))).otherwise(out)
        joined = F.array_join(out, "/")
        return F.when(joined == "", F.lit("/")).when(~joined.startswith("/"), F.concat(F.lit("/"), joined)) \
            .otherwise(joined)
    return let(segs, resolve)


def resolve_link(base: Column, link: Column) -> Column:
    """``urljoin(base, link)`` for hierarchical bases, natively.

    Absolute links of another (or a non-relative) scheme are returned as is,
    scheme-relative links take the base scheme, an empty path keeps the base
    path (and its query unless the link has one), other paths are merged with
    the base directory and ``.``/``..`` segments removed.
    """
    def join(b, l):
        b_scheme = F.lower(F.regexp_extract(b, _SCHEME_RE, 1))
        b_netloc = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
        b_rest = F.regexp_replace(F.regexp_replace(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"#.*$", "")
        b_path = F.regexp_replace(b_rest, r"\?.*$", "")
        b_query = F.when(F.contains(b_rest, F.lit("?")), F.regexp_extract(b_rest, r"\?(.*)$", 1))
        l_scheme = F.lower(F.regexp_extract(l, _SCHEME_RE, 1))
        same_scheme = (l_scheme == b_scheme) & l_scheme.isin(*USES_RELATIVE)
        rel0 = F.when(l_scheme == "", l).when(same_scheme, F.regexp_replace(l, _SCHEME_RE, ""))
        has_netloc = rel0.rlike(r"^//[^/?#]")
        # '//' with an empty authority: the rest is a path-relative reference
        rel = F.when(rel0.startswith("//") & ~has_netloc, F.regexp_replace(rel0, r"^//", "")).otherwise(rel0)

        def finish(path, query, frag):
            q = F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))
            f = F.when(F.coalesce(frag, F.lit("")) != "", F.concat(F.lit("#"), frag)).otherwise(F.lit(""))
            return F.concat(b_scheme, F.lit("://"), b_netloc, path, q, f)
        path, query, frag = _split_ref(rel)
        keep_base = finish(b_path, F.when(F.coalesce(query, F.lit("")) != "", query).otherwise(b_query), frag)
        merged = finish(_resolve_path(b_path, path), query, frag)
        return (F.when(l == "", b)
                 .when(rel.isNull(), l)
                 .when(has_netloc, F.concat(b_scheme, F.lit(":"), rel))
                 .when(path == "", keep_base)
                 .otherwise(merged))
    # Fast path (plain codegen'd expressions) for the two common shapes:
    # a link of another scheme is returned as is; a rooted path without dot
    # segments, query or fragment is appended to the base origin.  Everything
    # else takes the general path (lambda-bound, interpreted).
    b_scheme = F.lower(F.regexp_extract(base, _SCHEME_RE, 1))
    b_origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    l_scheme = F.lower(F.regexp_extract(link, _SCHEME_RE, 1))
    other_scheme = (l_scheme != "") & ((l_scheme != b_scheme) | ~l_scheme.isin(*USES_RELATIVE))
    rooted = (link.rlike(r"^/[^/?#]") | (link == "/")) & ~link.rlike(r"[?#]") & \
        ~link.rlike(r"(^|/)\.\.?(/|$)") & base.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    fast = (F.when(other_scheme, link)
             .when(rooted, F.concat(b_scheme, F.lit("://"), b_origin, link)))
    general = let(base, lambda b: let(link, lambda l: join(b, l)))
    return F.when(base.isNull() | link.isNull(), F.lit(None).cast("string")) \
        .when(other_scheme | rooted, fast).otherwise(general)
