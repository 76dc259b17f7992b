"""Randomised agreement of native text expressions with Python's string semantics."""

import random

from pyspark.sql import functions as F

from tidepool.functions import text as TX

ALPHABET = list("abcXYZ019 \n\t-_'`[]<>\\#.éßÉ&;") + ["  ", " "]


def _strings(n=500, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(0, 40))) for _ in range(n)]


def test_text_functions_agree_with_python(spark):
    vals = _strings()
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    rows = df.select("s", TX.md_escape(F.col("s")).alias("esc"), TX.word_count(F.col("s")).alias("wc"),
                     TX.has_min_words(F.col("s"), 3).alias("w3"), TX.casefold(F.col("s")).alias("fold"),
                     TX.py_strip(F.col("s")).alias("strip")).collect()
    specials = set("\\`[]<>")
    for r in rows:
        s = r.s
        assert r.esc == "".join("\\" + c if c in specials else c for c in s), s
        assert r.wc == len(s.split()), repr(s)
        assert r.w3 == (len(s.split()) >= 3), repr(s)
        assert r.strip == s.strip(), repr(s)
        assert r.fold == s.casefold(), repr(s)       # lower + ß→ss equals casefold on this alphabet


def test_py_title_agrees_with_python(spark):
    rnd = random.Random(9)
    alphabet = list("abcdeXYZ019 -_'.é")
    vals = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 25))) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    for r in df.select("s", TX.py_title(F.col("s")).alias("t")).collect():
        assert r.t == r.s.title(), repr(r.s)


def test_strip_html_agrees_with_python(spark):
    import html
    import re
    rnd = random.Random(13)
    parts = ["<p>", "</b>", "<a href='x'>", "&amp;", "&lt;", "&#233;", "&copy;", "&nbsp;", "text", " ", "\n", "é", ">", "<"]
    vals = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 15))) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    for r in df.select("s", TX.strip_html(F.col("s"), full_entities=True).alias("t")).collect():
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", r.s))).strip()
        assert r.t == want, repr(r.s)


def test_native_entities_agree_on_their_subset(spark):
    import html
    import re
    rnd = random.Random(17)
    parts = ["<i>", "</i>", "&amp;", "&lt;", "&gt;", "&quot;", "&#39;", "&copy;", "&middot;", "&nbsp;", "&hellip;",
             "&amp;lt;", "a", " ", "\t"]
    vals = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 15))) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    for r in df.select("s", TX.strip_html(F.col("s")).alias("t")).collect():
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", r.s))).strip()
        assert r.t == want, repr(r.s)


def test_casefold_tables_cover_every_letter(spark):
    letters = [c for c in map(chr, range(0x110000)) if c.casefold() != c]
    df = spark.createDataFrame([("a" + c + "Ω",) for c in letters], "s string")
    out = df.select("s", TX.casefold(F.col("s")).alias("f"))
    assert "Python" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.s for r in out.collect() if r.f != r.s.casefold()] == []
