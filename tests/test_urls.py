"""URL guard, safe links, allow-list, trackers, link resolution."""

import ipaddress
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tidepool.functions import urls as U
from tidepool.operators import verify as V


def ev(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("url,expected", [
    ("javascript:alert(1)", None),
    ("java\nscript:alert(1)", None),
    ("  JavaScript:alert(1)", None),
    ("data:text/html,x", None),
    ("https://a.example/x y<z>", "https://a.example/x%20y%3Cz%3E"),
    ("/relative/path", "/relative/path"),
    ("//cdn.example/x", "//cdn.example/x"),
])
def test_safe_link(spark, url, expected):
    assert ev(spark, U.safe_link, url) == expected


def test_ipv4_ranges_match_python(spark):
    rnd = random.Random(7)
    ips = ["0.0.0.1", "10.1.2.3", "100.64.0.1", "127.0.0.1", "169.254.169.254", "172.16.5.4", "172.32.0.1",
           "192.0.0.8", "192.0.0.9", "192.0.0.10", "192.0.2.1", "192.168.1.1", "198.18.0.1", "203.0.113.9",
           "224.0.0.1", "240.0.0.1", "255.255.255.255", "8.8.8.8", "93.184.216.34"]
    ips += [".".join(str(rnd.randrange(256)) for _ in range(4)) for _ in range(300)]
    df = spark.createDataFrame([(ip,) for ip in ips], "ip string")
    got = {r["ip"]: r["b"] for r in df.select("ip", U.ip_blocked(F.col("ip")).alias("b")).collect()}
    for ip in ips:
        o = ipaddress.ip_address(ip)
        want = o.is_private or o.is_loopback or o.is_link_local or o.is_reserved or o.is_multicast
        assert got[ip] == want, ip


def test_url_guard_reasons(spark):
    urls = spark.createDataFrame([
        ("ftp://files.example/x", "scheme"),
        ("http:///nohost", "empty_host"),
        ("http://metadata.google.internal/computeMetadata", "metadata_host"),
        ("http://169.254.169.254/latest", "metadata_host"),
        ("http://10.0.0.5/admin", "private_ip"),
        ("http://[::1]:8080/", "private_ip"),
        ("http://8.8.8.8/", None),
        ("https://internal.example/", "private_ip"),
        ("https://public.example/", None),
        ("https://nowhere.example/", "unresolved"),
        ("https://user:pw@Public.Example:443/p", None),
    ], "url string, want string")
    dns = spark.createDataFrame([("internal.example", "192.168.0.10"), ("public.example", "93.184.216.34"),
                                 ("public.example", "93.184.216.35")], "host string, ip string")
    for r in V.url_guard(urls, dns).collect():
        assert r["guard_reason"] == r["want"], r["url"]
        assert r["blocked"] == (r["want"] is not None)


def test_status_tiers(spark):
    df = spark.createDataFrame([(200, False), (301, False), (404, False), (410, False), (401, False),
                                (503, False), (None, False), (200, True)], "s int, b boolean")
    got = [r[0] for r in df.select(V.status_tier(F.col("s"), F.col("b"))).collect()]
    assert got == ["live", "live", "dead", "dead", "stale", "stale", "stale", "blocked"]


@pytest.mark.parametrize("url,ok", [
    ("https://www.youtube.com/@chan", True),
    ("https://YouTube.com/c/x", True),
    ("http://youtube.com/@chan", False),
    ("https://youtu.be:443/x", False),
    ("https://evil.example/youtube.com", False),
])
def test_host_allowlist(spark, url, ok):
    assert ev(spark, U.host_allowed, url) is ok


def test_tracker_filter(spark):
    df = spark.createDataFrame([
        ("https://www.google-analytics.com/collect", "script", True),
        ("https://cdn.example/app.js", "script", False),
        ("https://cdn.example/logo.png", "image", True),
        ("https://cdn.example/font.woff", "font", True),
        ("relative/path", "document", False),
    ], "u string, t string, want boolean")
    for r in df.select(U.request_dropped(F.col("u"), F.col("t")).alias("got"), "want").collect():
        assert r["got"] == r["want"]


def test_resolve_link_matches_urljoin(spark):
    bases = ["https://a.example/blog/index.html?x=1", "https://a.example/blog/", "https://a.example/blog/list",
             "http://a/b/c/d;p?q", "https://a.example", "https://u:p@a.example:8443/x/y/z?k=v#frag"]
    links = ["/posts/one", "//cdn.example/x", "post-2", "../up/./here", "https://b.example/abs", "g", "./g", "g/",
             "/g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g", "../..",
             "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g",
             "./../g", "./g/.", "g/./h", "g/../h", "http:g", "mailto:x@y", "ftp://f.example/x", "a//b", "HTTPS:g",
             "/a?", "/a#", "/a?b#c", "/a/b/", "/", "//", "/a//b", "/a/./b", "/a/../b", "/.", "HTTP://x/y", "/a;p"]
    pairs = [(b, l) for b in bases for l in links]
    df = spark.createDataFrame(pairs, "b string, l string")
    got = [r[0] for r in df.select(U.resolve_link(F.col("b"), F.col("l"))).collect()]
    bad = [(b, l, g, urljoin(b, l)) for (b, l), g in zip(pairs, got) if g != urljoin(b, l)]
    assert not bad, bad[:10]


def test_url_hash(spark):
    import hashlib
    u = "https://example.com/é"
    assert ev(spark, U.url_hash, u) == hashlib.sha1(u.encode()).hexdigest()[:6]


def test_decode_body_charsets(spark):
    from tidepool.sources.scans import decode_body
    text = "café – ok"
    rows = [(text.encode("utf-8"), "utf-8"), (text.encode("utf-16-le"), "UTF-16LE"),
            (text.encode("cp1252"), "windows-1252"), (b"\xff\xfeok", "utf-8"),
            (('<?xml version="1.0" encoding="ISO-8859-1"?><a>' + "é</a>").encode("latin-1"), "utf-8")]
    df = spark.createDataFrame(rows, "b binary, cs string")
    got = [r[0] for r in df.select(decode_body(F.col("b"), F.col("cs"))).collect()]
    assert got[0] == text and got[1] == text and got[2] == text
    assert got[3].endswith("ok") and "�" in got[3]
    assert got[4].endswith("é</a>")


def test_ipv6_native_matches_python(spark):
    rnd = random.Random(11)
    cases = ["::1", "::", "fe80::1", "fe80::1%eth0", "FC00::5", "2001:db8::1", "2001:1::1", "2001:4860:4860::8888",
             "ff02::1", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "64:ff9b:1::5", "2002::1", "1:2:3:4:5:6:7:8",
             "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "2001:db8::192.0.2.33", "100::1", "2606:4700::1111",
             "1::2::3", ":1:2::", "g::1", "1:2:3:4:5:6:7:8:9", "12345::1", "1.2.3.4", "", "::ffff:1.2.3"]
    for _ in range(300):
        cases.append(str(ipaddress.IPv6Address(rnd.getrandbits(128))))
        n = rnd.randrange(1, 7)
        cases.append(":".join(f"{rnd.getrandbits(16):x}" for _ in range(n)) + "::" + f"{rnd.getrandbits(16):x}")
    df = spark.createDataFrame([(c,) for c in cases], "h string")
    got = {r.h: r.b for r in df.select("h", U.ip_blocked(F.col("h")).alias("b")).collect()}
    for c in cases:
        try:
            o = ipaddress.ip_address(c)
            want = o.is_private or o.is_loopback or o.is_link_local or o.is_reserved or o.is_multicast
        except ValueError:
            want = None
        assert got[c] == want, c
