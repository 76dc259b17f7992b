"""Text column expressions.

All of these are native Catalyst expressions (they stay inside whole-stage
codegen).  Regexes use ``(?U)`` so ``\\s``/``\\w``/``\\d`` are Unicode-aware, as
Python's ``str`` patterns are.  The one residue: Python also treats
U+001C..U+001F as whitespace; Java does not.
"""

from __future__ import annotations

import functools
import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool import contracts as C

# ---------------------------------------------------------------------------
# HTML entities decoded natively.  ``&amp;`` comes last, so text
# is never decoded twice (``&amp;lt;`` → ``&lt;``).
# ---------------------------------------------------------------------------
NATIVE_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
    ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&reg;", "®"),
    ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"),
    ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&"),
)
# Decimal references decoded natively: U+00A0 up to the surrogates.  The HTML
# rules remap or refuse some of the others, which the full table takes care of.
_NUMERIC = r"(?:1[6-9][0-9]|[2-9][0-9]{2}|[1-9][0-9]{3}|[1-4][0-9]{4}|5[0-4][0-9]{3}|55[01][0-9]{2}|552[0-8][0-9]|5529[0-5])"
_XML_NAMES = ("lt", "gt", "quot", "apos", "amp")


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (a lambda-bound variable),
    instead of copying its expression tree into every use."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _named(c: Column, pairs) -> Column:
    for k, v in pairs:
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def decode_entities(c: Column) -> Column:
    """Decode the common named entities and decimal references natively."""
    def one(s: Column, code: Column) -> Column:
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("int")), 4, "0")), "UTF-16BE")
        return F.replace(s, F.concat(F.lit("&#"), code, F.lit(";")), char)

    def numeric(t: Column) -> Column:
        codes = F.array_distinct(F.regexp_extract_all(t, F.lit(f"&#({_NUMERIC});"), F.lit(1)))
        return F.when(F.contains(t, F.lit("&#")), F.aggregate(codes, t, one)).otherwise(t)

    def decoded(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("&")), _named(let(_named(t, NATIVE_ENTITIES[:-1]), numeric), NATIVE_ENTITIES[-1:])).otherwise(t)

    return let(c, decoded)


def needs_full_table(c: Column) -> Column:
    """True where a text holds an entity that :func:`decode_entities` does not know."""
    known = "|".join(k[1:-1] for k, _ in NATIVE_ENTITIES)
    return F.coalesce(c.rlike(f"&(?!(?:{known}|#{_NUMERIC});)(?:#|[A-Za-z])"), F.lit(False))


@F.pandas_udf(T.StringType())
def unescape_full(s: pd.Series) -> pd.Series:
    """Full HTML5 entity table (numeric and legacy forms), Arrow-batched."""
    return s.map(lambda x: None if x is None else _html.unescape(x))


def unescape(c: Column, full: bool = True, source: Column | None = None) -> Column:
    """HTML entities decoded; rows with rare ones (and only they) go through the full table in Python.

    ``source`` is the text that ``c`` was made from, if the test for rare
    entities is cheaper there.
    """
    if not full:
        return decode_entities(c)
    rare = needs_full_table(c if source is None else source)
    return F.coalesce(unescape_full(F.when(rare, c)), decode_entities(c))


@F.pandas_udf(T.StringType())
def unescape_markup(s: pd.Series) -> pd.Series:
    """The full entity table over a text that is still markup: what would become markup stays an entity."""
    import re

    def decoded(m):
        made = _html.unescape(m[0])
        return m[0] if made == m[0] else _html.escape(made, quote=False)
    return s.map(lambda x: None if x is None else re.sub(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{0,31};?)", decoded, x))


@F.pandas_udf(T.StringType())
def _html_names(s: pd.Series) -> pd.Series:
    import re
    from html.entities import html5

    def known(m):
        return m[0] if m[1] in _XML_NAMES else html5.get(m[1] + ";", m[0])
    return s.map(lambda x: None if x is None else re.sub(r"&([A-Za-z][A-Za-z0-9]*);", known, x))


def decode_html_names(xml: Column) -> Column:
    """HTML's named entities in an XML text, but for XML's own five, decoded (only such texts go through Python)."""
    rare = F.coalesce(xml.rlike(f"&(?!(?:{'|'.join(_XML_NAMES)});)[A-Za-z][A-Za-z0-9]*;"), F.lit(False))
    return F.coalesce(_html_names(F.when(rare, xml)), xml)


def collapse_ws(c: Column) -> Column:
    """Runs of Unicode whitespace → one space, then trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def py_strip(c: Column) -> Column:
    """``str.strip()``: leading and trailing Unicode whitespace."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def py_rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def word_count(c: Column) -> Column:
    """``len(text.split())``."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def has_min_words(c: Column, n: int) -> Column:
    """``len(text.split()) >= n`` without counting past the n-th word
    (possessive quantifiers: the match stops there, no backtracking)."""
    if n <= 0:
        return F.lit(True)
    return F.coalesce(c, F.lit("")).rlike(rf"(?U)^\s*+(?:\S++\s++){{{n - 1}}}\S")


def strip_html(c: Column, full_entities: bool = True) -> Column:
    """Tags → space, entity-decode, collapse whitespace, strip; null → ''."""
    t = F.regexp_replace(c, r"<[^>]+>", " ")
    t = unescape(t, full_entities, source=c)
    return F.coalesce(collapse_ws(t), F.lit(""))


# Elements that hold no article text, and elements that end a block of text.
BOILERPLATE_TAGS = ("head", "script", "style", "noscript", "template", "nav", "header", "footer", "aside")
BLOCK_TAGS = ("address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "form",
              "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tr", "ul")
# The word counts and link densities of the decision tree of Kohlschütter,
# Fankhauser and Nejdl, "Boilerplate Detection using Shallow Text Features" (2010), number-of-words form.
MAX_LINK_DENSITY, MAX_LINK_DENSITY_BEFORE = 0.333333, 0.555556
FEW_WORDS, FEW_WORDS_NEXT, FEW_WORDS_BEFORE = 16, 15, 4
FEW_WORDS_AFTER_LINKS, FEW_WORDS_NEXT_AFTER_LINKS = 40, 17


def _is_content(before: Column, block: Column, after: Column) -> Column:
    """Whether a block is article text, from its own and its neighbours' words and share of link words."""
    def words(b):
        return F.coalesce(b["n"], F.lit(0))

    links_before = F.coalesce(before["links"] / before["n"], F.lit(0.0)) > MAX_LINK_DENSITY_BEFORE
    short = (words(block) <= FEW_WORDS) & (words(after) <= FEW_WORDS_NEXT) & (words(before) <= FEW_WORDS_BEFORE)
    short_after_links = (words(block) <= FEW_WORDS_AFTER_LINKS) & (words(after) <= FEW_WORDS_NEXT_AFTER_LINKS)
    return _mostly_text(block) & ~F.when(links_before, short_after_links).otherwise(short)


def _mostly_text(block: Column) -> Column:
    return block["links"] / block["n"] <= MAX_LINK_DENSITY


def text_blocks(html: Column) -> Column:
    """The page's blocks of text in order: (text, n words, links: words inside links).

    Comments and elements without article text go; block elements end a block,
    inline markup and table cells do not.
    """
    h = F.regexp_replace(html, r"[\x02-\x04]", " ")
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", " ")
    for tag in BOILERPLATE_TAGS:
        h = F.regexp_replace(h, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "\x02")
    h = F.regexp_replace(h, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>", "\x02")
    h = F.regexp_replace(h, r"(?i)<a\b[^>]*>", " \x03")
    h = F.regexp_replace(h, r"(?i)</a\s*>", "\x04 ")
    h = F.regexp_replace(h, r"<[^>]+>", " ")

    def block(x: Column) -> Column:
        linked = F.array_join(F.regexp_extract_all(x, F.lit(r"\x03([^\x03\x04]*)"), 1), " ")
        text = F.translate(x, "\x03\x04", "  ")
        return F.struct(text.alias("text"), word_count(text).alias("n"), word_count(linked).alias("links"))

    return F.filter(F.transform(F.split(h, "\x02"), block), lambda b: b["n"] > 0)


def main_text(html: Column, full_entities: bool = True) -> Column:
    """Readable article text from a full page.

    The page is cut into blocks, and each block is kept or not by how many words
    it and its neighbours have and how many of them are links (see
    :func:`text_blocks`); where no block passes, those that are mostly not links
    are kept.  The kept text is entity-decoded and its white space collapsed; null → ''.
    """
    def chosen(blocks: Column) -> Column:
        content = F.filter(blocks, lambda b, i: _is_content(F.get(blocks, i - 1), b, F.get(blocks, i + 1)))
        return F.when(F.size(content) > 0, content).otherwise(F.filter(blocks, _mostly_text))

    page = F.coalesce(html, F.lit(""))
    if full_entities:  # pages with rare entities (and only they) go through the full table in Python
        page = F.coalesce(unescape_markup(F.when(needs_full_table(html), html)), page)
    kept = let(text_blocks(page), chosen)
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return F.coalesce(collapse_ws(decode_entities(text)), F.lit(""))


def sanitize_title(c: Column, max_len: int = C.TITLE_MAX_LEN, full_entities: bool = True) -> Column:
    """File-name-safe title (the stem before the hash suffix)."""
    t = unescape(F.coalesce(c, F.lit("")), full_entities)
    t = F.replace(t, F.lit("\x00"), F.lit(""))
    t = F.regexp_replace(t, r"(?U)\s*#\w+", "")
    t = F.regexp_replace(t, "[—–]", " - ")
    t = F.regexp_replace(t, r'[<>:"/\\|?*]', "")
    t = collapse_ws(t)
    t = F.regexp_replace(t, r"^[. ]+", "")
    t = F.when(F.char_length(t) > max_len,
               F.regexp_replace(F.substring(t, 1, max_len), r" [^ ]*$", "")).otherwise(t)
    return F.when(t == "", F.lit(C.UNTITLED_STEM)).otherwise(t)


def md_escape(c: Column) -> Column:
    """Backslash-escape ``\\ ` [ ] < >`` in untrusted text."""
    return F.regexp_replace(c, r"([\\`\[\]<>])", r"\\$1")


def snippet(summary: Column, n: int = C.SNIPPET_CHARS) -> Column:
    """First ``n`` chars, right-stripped, escaped, '…' iff the original is longer."""
    s = F.coalesce(summary, F.lit(""))
    head = md_escape(py_rstrip(F.substring(s, 1, n)))
    return F.concat(head, F.when(F.char_length(s) > n, F.lit("…")).otherwise(F.lit("")))


def py_title(c: Column) -> Column:
    """``str.title()``: a letter following a non-letter is upper-cased, others lower."""
    marked = F.regexp_replace(F.lower(c), r"([^\p{L}])", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def slug_text(link: Column) -> Column:
    """Last path segment, '-'/'_' → space."""
    last = F.element_at(F.split(F.regexp_replace(link, r"/+$", ""), "/"), -1)
    return F.regexp_replace(last, r"[-_]", " ")


def title_from_body(content: Column, url: Column) -> Column:
    """First ``# `` heading within the first 10 lines, else the URL slug title-cased.

    A heading that reads exactly "Untitled" falls through to the URL, and an
    empty slug leaves "Untitled".
    """
    # split limit 11: at most 10 lines are materialised (the 11th holds the rest)
    lines = F.slice(F.split(F.coalesce(content, F.lit("")), "\n", 11), 1, 10)
    heads = F.filter(lines, lambda x: py_strip(x).startswith("# "))
    first = F.try_element_at(heads, F.lit(1))
    heading = py_strip(F.substring(py_strip(first), 3, 1 << 30))
    part = F.element_at(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), r"/+$", ""), "/"), -1)
    fallback = F.when(part != "", py_title(F.regexp_replace(part, r"[-_]", " "))).otherwise(F.lit("Untitled"))
    return F.when(first.isNull() | (heading == "Untitled"), fallback).otherwise(heading)


def date_in_text(content: Column, run_date: str = C.RUN_DATE) -> Column:
    """First ``YYYY-MM-DD`` within the first 500 chars, else the run date."""
    found = F.regexp_extract(F.substring(content, 1, 500), r"(?U)(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(run_date))


def classify_content(content: Column, min_body_words: int = C.DEFAULT_MIN_BODY_WORDS) -> Column:
    """'full' (≥500 words, tested first), 'truncated' (≥ min), else 'stub'."""
    c = F.coalesce(content, F.lit(""))
    return (F.when(has_min_words(c, C.FULL_CONTENT_WORDS), "full")
             .when(has_min_words(c, min_body_words), "truncated").otherwise("stub"))


def is_usable(content: Column, min_body_words: int = C.DEFAULT_MIN_BODY_WORDS) -> Column:
    return classify_content(content, min_body_words) != "stub"


def keyword_match(text: Column, mode: Column, include: Column) -> Column:
    """Case-insensitive substring test: 'all' needs every keyword, anything else any.

    A null or empty keyword list passes.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda k: F.contains(low, F.lower(k))
    return (F.when(include.isNull() | (F.size(include) == 0), F.lit(True))
             .when(mode == "all", F.forall(include, hit))
             .otherwise(F.exists(include, hit)))


_FOLDS_OTHERWISE = "[\u00b5\u0149\u017f\u01f0]|[^\u0000-\u024f]"


@functools.cache
def _full_folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """``str.casefold`` as tables: letters that fold to one letter and what they fold to, and those that fold to several."""
    folds = [(c, c.casefold()) for c in map(chr, range(0x110000)) if c.casefold() != c]
    single = [(c, f) for c, f in folds if len(f) == 1]
    return "".join(c for c, _ in single), "".join(f for _, f in single), tuple((c, f) for c, f in folds if len(f) > 1)


def _casefold_any(c: Column) -> Column:
    letters, folded, several = _full_folds()
    found = "[" + "".join(letter for letter, _ in several) + "]"
    # one pass for each letter that folds to several, over texts that hold any of them
    spread = F.when(c.rlike(found), _named(c, several)).otherwise(c)
    return F.translate(spread, letters, folded)


def casefold_array(arr: Column) -> Column:
    """:func:`casefold` of every string of an array."""
    return F.transform(arr, casefold)


def casefold(c: Column) -> Column:
    """``str.casefold()``: lower case for ASCII, ß → ss besides for Latin text; texts with other
    scripts, or one of the few Latin letters that fold otherwise, by the tables of full case folding."""
    return (F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
             .when(c.rlike(_FOLDS_OTHERWISE), _casefold_any(c))
             .otherwise(F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))))
