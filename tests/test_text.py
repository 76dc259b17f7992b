"""Text column expressions against Python's own string semantics."""

import html
import re

import pytest
from pyspark.sql import functions as F

from tidepool.functions import text as TX


def ev(spark, expr, value, t="string"):
    return spark.createDataFrame([(value,)], f"x {t}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,expected", [
    ("<p>Hello&nbsp;<b>world</b></p>", "Hello world"),
    ("a &amp;lt; b", "a &lt; b"),          # single-pass decoding
    ("  x\n\n y  ", "x y"),
    (None, ""),
])
def test_strip_html(spark, raw, expected):
    assert ev(spark, TX.strip_html, raw) == expected


def test_strip_html_full_entity_table(spark):
    raw = "caf&eacute; &#8364;5 &#x41;"
    assert ev(spark, lambda c: TX.strip_html(c, full_entities=True), raw) == html.unescape(raw)


def test_main_text_keeps_paragraphs_and_drops_boilerplate(spark):
    para = "A paragraph of the article that runs on for well over sixteen words so that it counts as text by itself."
    page = ("<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class=ad>Buy this now</div>"
            f"<article><h1>Heading</h1><p>{para}</p><p>{para} &amp; <a href=y>more</a></p></article>"
            "<div><a href=1>Other story one</a> <a href=2>Other story two</a></div><script>var x</script><footer>Imprint</footer></body></html>")
    assert ev(spark, TX.main_text, page) == f"Heading {para} {para} & more"
    rare = "&hearts; &#x2F; &lt;b&gt; &AMP; &amp;hearts; &notit; R&D &copy;"
    assert ev(spark, TX.main_text, f"<p>{rare}</p>") == html.unescape(rare)
    assert ev(spark, TX.main_text, None) == "" and ev(spark, TX.main_text, "") == ""
    assert ev(spark, TX.main_text, "<p>short note</p>") == "short note"   # nothing passes: what is not links stays


def _labelled_pages(seed):
    """(html, words of the body text) of pages in several layouts."""
    import random

    rng = random.Random(seed)
    fresh = iter(range(10 ** 6))

    def words(n, kind):
        return " ".join(f"{kind}{next(fresh)}" for _ in range(n))

    def links(n, tag="li"):
        return "".join(f"<{tag}><a href='/{k}'>{words(rng.randint(1, 6), 'x')}</a></{tag}>" for k in range(n))

    def article(tag="p"):
        body = [f"<h1>{words(rng.randint(3, 12), 'b')}</h1>"]
        for _ in range(rng.randint(3, 9)):
            n = rng.choice([12, 25, 40, 80, 140])
            body.append(f"<{tag}>{words(n // 2, 'b')} <a href='#'>{words(2, 'b')}</a> <em>{words(n - n // 2, 'b')}</em></{tag}>")
            if rng.random() < 0.2:
                body.append(f"<h2>{words(4, 'b')}</h2>")
        return "".join(body)

    layouts = (
        lambda: f"<nav>{links(8)}</nav><div class=cookie>{words(9, 'x')}</div><article>{article()}</article><footer>{words(30, 'x')}</footer>",
        lambda: f"<div id=menu><ul>{links(12)}</ul></div><div id=main>{article('div')}</div><div id=side><h3>{words(2, 'x')}</h3><ul>{links(10)}</ul></div>",
        lambda: f"<table><tr><td>{links(6, 'span')}</td></tr></table>{article()}<p>{words(3, 'x')}</p><div>{links(9, 'div')}</div><div>{words(8, 'x')}</div>",
        lambda: f"<header>{words(20, 'x')}</header><main>{article()}<ul>{links(5)}</ul></main><aside>{words(40, 'x')}</aside>",
        lambda: f"<div>{words(5, 'x')}</div><div>{links(7, 'span')}</div>{article()}<form>{words(4, 'x')}</form><div>{links(20, 'div')}</div>",
    )
    for k in range(40):
        html = f"<html><head><title>{words(6, 'x')}</title></head><body>{layouts[k % len(layouts)]()}<script>{words(50, 'x')}</script></body></html>"
        yield html


def test_main_text_finds_the_body_of_labelled_pages(spark):
    pages = list(_labelled_pages(5))
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    found = hit = body = 0
    for r in df.select("html", TX.main_text(F.col("html")).alias("text")).collect():
        got = set(r.text.split())
        want = set(re.findall(r"\bb\d+", r.html))
        found, hit, body = found + len(got), hit + len(got & want), body + len(want)
    assert hit / found >= 0.9 and hit / body >= 0.9, (hit / found, hit / body)



@pytest.mark.parametrize("title,expected", [
    ("AI &amp; agents #ai #llm", "AI & agents"),
    ("Part 1 — the start", "Part 1 - the start"),
    ('a<b>:c"d/e\\f|g?h*i', "abcdefghi"),
    ("...hidden", "hidden"),
    ("", "untitled"),
    ("’curly quotes‘ stay", "’curly quotes‘ stay"),
    ("word " * 30, ("word " * 20).strip()),  # cut at the last space within 100 chars
    ("x" * 120, "x" * 100),
])
def test_sanitize_title(spark, title, expected):
    assert ev(spark, TX.sanitize_title, title) == expected


def test_md_escape(spark):
    assert ev(spark, TX.md_escape, "x](https://evil) [`<a>`\\") == "x\\](https://evil) \\[\\`\\<a\\>\\`\\\\"


def test_snippet(spark):
    s = "a" * 119 + "  " + "b" * 10
    out = ev(spark, TX.snippet, s)
    assert out == "a" * 119 + "…"
    assert ev(spark, TX.snippet, "short [x]") == "short \\[x\\]"
    assert ev(spark, TX.snippet, None) == ""


@pytest.mark.parametrize("s", ["fr report 12", "gpt4all it's", "élan vital", "hello-world_x"])
def test_py_title(spark, s):
    assert ev(spark, TX.py_title, s) == s.title()


def test_title_from_body(spark):
    df = spark.createDataFrame([
        ("intro\n  # My Heading  \nmore", "https://x/a/b-c_d"),
        ("no heading here", "https://x/posts/big-news_today/"),
        ("# Untitled\ntext", "https://x/fallback-slug"),
        ("#nospace\ntext", ""),
    ], "c string, u string")
    got = [r[0] for r in df.select(TX.title_from_body(F.col("c"), F.col("u"))).collect()]
    assert got == ["My Heading", "Big News Today", "Fallback Slug", "Untitled"]


def test_date_in_text(spark):
    assert ev(spark, TX.date_in_text, "Posted 2024-03-09 by x") == "2024-03-09"
    assert ev(spark, TX.date_in_text, "x" * 495 + " 2024-03-09") == "2024-02-01"


@pytest.mark.parametrize("n,cls", [(499, "truncated"), (500, "full"), (200, "truncated"), (199, "stub")])
def test_classify_content_boundaries(spark, n, cls):
    assert ev(spark, TX.classify_content, " ".join(["w"] * n)) == cls


def test_keyword_match(spark):
    df = spark.createDataFrame([
        ("The AI Agents", "any", ["agents", "zzz"], True),
        ("The AI Agents", "all", ["agents", "zzz"], False),
        ("The AI Agents", "all", ["AGENTS", "ai"], True),
        ("anything", "any", [], True),
        ("abc", "weird", ["B"], True),          # unknown mode behaves as any
        ("abc", None, None, True),
    ], "t string, m string, inc array<string>, want boolean")
    for r in df.select(TX.keyword_match(F.col("t"), F.col("m"), F.col("inc")).alias("got"), "want").collect():
        assert r["got"] == r["want"]


def test_slug_and_words(spark):
    assert ev(spark, TX.slug_text, "/blog/my-post_name/") == "my post name"
    assert ev(spark, TX.word_count, " a  b\nc d ") == 4


@pytest.mark.parametrize("text", ["", "   ", "a", " a b ", "w " * 99, "w " * 100, "\nw\t" * 100 + "x", "é " * 150])
def test_has_min_words_matches_split(spark, text):
    for n in (1, 2, 100):
        got = spark.createDataFrame([(text,)], "x string").select(TX.has_min_words(F.col("x"), n)).first()[0]
        assert got == (len(text.split()) >= n), (repr(text[:20]), n)
