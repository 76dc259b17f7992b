"""Personal data, and the terms that give it away, in DataFrame functions only.

Base spans are e-mail and IP addresses, card and phone numbers, found by patterns
over the whole text, leftmost and without overlap for each kind; matches that
fail their check (parts up to 255, Luhn, digits) are dropped.

Information-theoretic sanitisation then looks at the words up to ``CONTEXT``
characters around each span.  With document frequencies over the whole corpus, a
term t gives away the share PMI(e; t) / IC(e) of the information of an entity e,
where PMI(e; t) = log2(N n(e, t) / (n(e) n(t))) and IC(e) = log2(N / n(e)).  From
``REMOVE`` on the term is removed near e, from ``GENERALISE`` on it is replaced by
its shape.  A pair counts when it stands in ``SUPPORT`` different contexts, so
copies of one document are no evidence.

Only spans, their context words and word counts (pre-aggregated by each task)
are shuffled; joins read written tables, so a frequent entity is split.

Defined cases: null and empty texts have no spans; spans are in code points, end
exclusive; repeated rows (same identifier and text) are one document in the
counts and get the same spans; a term span near two entities is named once, the
stricter way; in an empty corpus there is nothing to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepool.functions.text import let

from .common import staged

KINDS = ("email", "ip", "card", "phone", "remove", "generalise")
#: Characters on either side of a span whose words are looked at.
CONTEXT = 60
#: Pieces of a text that a context is cut from: no context makes Spark walk the whole text.
PIECE = 1024
#: Lengths that are added up at a time; both loops below stay short for millions of spans.
STRETCH = 256
#: Places of spans are compared within cells of this many characters.
CELL = 4096
SUPPORT = 2
REMOVE, GENERALISE = 0.95, 0.75

# Each finds what the plain pattern finds, written so that no run is tried twice
# and no group recurses: runs are taken as a whole and entered at their start.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){11,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 1, 2 * d - F.when(d >= 5, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _parts_fit(value: Column) -> Column:
    return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")


def _sums(lengths: Column) -> Column:
    """Running totals of an array of lengths: within stretches, then over the totals before each.

    Appending to an array copies it, so one loop over all would take quadratic time.
    """
    def append(s: Column, x: Column) -> Column:
        at = s["at"] + x
        return F.struct(at.alias("at"), F.concat(s["out"], F.array(at)).alias("out"))

    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
    running = lambda xs, at: F.aggregate(xs, start(at), append, lambda s: s["out"])

    def whole(xs: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(STRETCH))
        return let(F.transform(firsts, lambda k: F.slice(xs, k + 1, F.lit(STRETCH))), stretches)

    def stretches(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + x))
        return let(running(totals, F.lit(0)), lambda ends: F.flatten(F.transform(
            parts, lambda p, k: running(p, F.when(k == 0, 0).otherwise(F.get(ends, k - 1))))))

    return let(lengths, whole)


def _found(text: Column, rank: int, pattern: str, fits=None) -> Column:
    """All matches as spans: the texts between them give their places."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        lengths = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        return F.zip_with(found, _sums(lengths), lambda m, end: F.struct(
            (end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), m.alias("value")))

    spans = let(matches, placed)
    if fits is not None:
        spans = F.filter(spans, lambda s: fits(s["value"]))
    return F.when(text.rlike(pattern), spans).otherwise(F.array()).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """Spans (start, rank of the kind, end, value) of the four kinds, by start, then kind."""
    count = lambda low, high: lambda v: F.length(_digits(v)).between(low, high)
    each = [_found(text, 0, _EMAIL), _found(text, 1, _IP, _parts_fit), _found(text, 2, _CARD, _luhn), _found(text, 3, _PHONE, count(9, 15))]
    return F.when(text.isNull(), F.array().cast(_SPAN)).otherwise(F.array_sort(F.concat(*each)))


def _words_with_places(piece: Column, offset: Column) -> Column:
    """Words (lower case, three letters or digits at least) of a short piece with their places in the text."""
    start = F.struct(offset.cast("int").alias("at"), F.array().cast("array<struct<term:string,start:int,end:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        end = s["at"] + F.length(x)
        word = F.struct(F.lower(x).alias("term"), s["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x.rlike(r"^[\p{L}\p{N}]{3,}$"), F.concat(s["out"], F.array(word))).otherwise(s["out"]).alias("out"))

    pieces = F.regexp_extract_all(piece, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.aggregate(pieces, start, step, lambda s: s["out"])


def _context(pieces: Column, length: Column, span: Column) -> Column:
    """The text up to ``CONTEXT`` characters before and after a span, of a text in pieces."""
    def cut(at: Column, size: Column) -> Column:  # at most CONTEXT characters, so of two pieces
        k = F.floor(at / PIECE).cast("int")
        two = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
        return F.substring(two, at - k * PIECE + 1, size)

    low = F.greatest(span["start"] - CONTEXT, F.lit(0))
    return F.struct(_entity(span["rank"], span["value"]).alias("entity"), low.alias("low"), span["end"].alias("end"), cut(low, span["start"] - low).alias("before"),
                    cut(span["end"], F.lit(CONTEXT)).alias("after"), (length <= span["end"] + CONTEXT).alias("last"))


def _contexts(text: Column, spans: Column) -> Column:
    """For each span its entity and the text around it."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(F.struct(pieces.alias("pieces"), F.length(text).alias("length")), lambda t: F.transform(spans, lambda s: _context(t["pieces"], t["length"], s)))


def _context_words(c: Column) -> Column:
    """The whole words of a context: one that its ends cut is left out, unless the text starts or ends there."""
    gone = F.when(c["low"] > 0, F.length(F.regexp_extract(c["before"], r"^[\p{L}\p{N}]*", 0))).otherwise(0)
    tail = F.when(c["last"], c["after"]).otherwise(F.regexp_replace(c["after"], r"[\p{L}\p{N}]+$", ""))
    return F.concat(_words_with_places(F.substring(c["before"], gone + 1, F.lit(CONTEXT)), c["low"] + gone), _words_with_places(tail, c["end"]))


def _entity(rank: Column, value: Column) -> Column:
    return F.concat(rank.cast("string"), F.lit(":"), F.when(rank.isin(2, 3), _digits(value)).otherwise(F.lower(value)))


def document_words(text: Column) -> Column:
    """The distinct lower-case words of a text."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def disclosing_terms(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity, term, rank): the terms to remove (rank 4) or generalise (5) near an entity.

    ``texts`` has column text; ``mentions`` rows (id, key, entity, context, term), one per context word.
    """
    pairs = staged(mentions.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct(F.struct("id", "key")).alias("docs"))
                   .where(F.col("contexts") >= SUPPORT), "pii-pairs")
    entities = staged(mentions.select("entity", "id", "key").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")), "pii-entities")
    counts = texts.select(F.explode(document_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    terms = staged(counts.join(pairs.select("term").distinct(), "term", "left_semi"), "pii-terms")
    total = texts.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    known = staged(pairs.join(terms, "term"), "pii-known").join(entities, "entity")
    bits = lambda x: F.log2(x.cast("double"))
    pmi = bits(F.col("docs") * F.lit(total)) - bits(F.col("n_entity")) - bits(F.greatest("n_term", "docs"))
    share = F.try_divide(pmi, bits(F.lit(total)) - bits(F.col("n_entity")))
    return known.withColumn("share", share).where(F.col("share") >= GENERALISE).select(
        "entity", "term", F.when(F.col("share") >= REMOVE, 4).otherwise(5).alias("rank"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, key (a hash of the text), base spans and the added term spans."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    spans = texts.withColumn("spans", base_spans(F.col("text")))
    around = F.when(F.size("spans") > 0, _contexts(F.col("text"), F.col("spans")))
    base = staged(spans.select("id", "key", "spans", around.alias("around")), "pii-base")
    # the words are taken one context a row: those of all spans of a long text would not fit one row
    each = base.select("id", "key", F.explode("around").alias("a")).select("id", "key", F.col("a.entity").alias("entity"), _context_words(F.col("a")).alias("words"))
    contexts = each.select("id", "key", "entity", F.xxhash64(F.transform("words", lambda w: w["term"])).alias("context"), F.explode("words").alias("w"))
    words = staged(contexts.select("id", "key", "entity", "context", F.col("w.term").alias("term"), F.col("w.start").alias("start"), F.col("w.end").alias("end")), "pii-words")
    told = staged(disclosing_terms(texts, words.select("id", "key", "entity", "context", "term").distinct()), "pii-told")
    near = staged(words.join(told, ["entity", "term"]).groupBy("id", "key", "start", "end").agg(F.min("rank").alias("rank")), "pii-near")
    added = (_apart(near, base).groupBy("id", "key").agg(F.collect_list(F.struct("start", "rank", "end")).alias("added"))
             .select(F.col("id").alias("of"), F.col("key").alias("of_key"), "added"))
    joined = base.join(staged(added, "pii-added"), (F.col("key") == F.col("of_key")) & F.col("id").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("id").alias(id_col), "key", "spans", F.coalesce("added", F.array().cast("array<struct<start:int,rank:int,end:int>>")).alias("added"))


def _apart(terms: DataFrame, base: DataFrame) -> DataFrame:
    """The terms (id, key, start, end, rank) that overlap no base span.

    Both sides are dealt out by document and cell, so a document with very many
    spans is worked on by many tasks and no term meets all of its spans.
    """
    cells = lambda s, e: F.explode(F.sequence(F.floor(s / CELL), F.floor((e - 1) / CELL)))
    marked = base.join(terms.select("key").distinct(), "key", "left_semi").select("id", "key", F.explode("spans").alias("s"))
    marked = marked.select(F.col("id").alias("of"), F.col("key").alias("of_key"), F.col("s.start").alias("a"), F.col("s.end").alias("b"),
                           cells(F.col("s.start"), F.col("s.end")).alias("of_cell"))
    placed = terms.withColumn("cell", cells(F.col("start"), F.col("end")))
    same = (F.col("key") == F.col("of_key")) & (F.col("cell") == F.col("of_cell")) & F.col("id").eqNullSafe(F.col("of"))
    hit = placed.join(marked, same & (F.col("a") < F.col("end")) & (F.col("start") < F.col("b")), "left_semi").select("id", "key", "start", "end")
    hit = staged(hit.distinct().toDF("of", "of_key", "a", "b"), "pii-hit")
    return terms.join(hit, (F.col("key") == F.col("of_key")) & (F.col("start") == F.col("a")) & (F.col("end") == F.col("b")) & F.col("id").eqNullSafe(F.col("of")), "left_anti")


def _named(span: Column) -> Column:
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), span["rank"] + 1)
    return F.concat(kind, F.lit(":"), span["start"].cast("string"), F.lit(":"), span["end"].cast("string"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts by kind, the digest of the base spans, and all spans as text."""
    found = find_spans(docs, id_col, text_col)
    joined = lambda spans: F.array_join(F.transform(spans, _named), ",")
    placed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    of_rank = lambda k: F.filter("spans", lambda s: s["rank"] == k)
    counts = [F.size(of_rank(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select(id_col, *counts, F.sha2(joined(F.col("spans")), 256).alias("base_sha256"),
                        joined(F.array_sort(F.concat(placed, "added"))).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced: base spans and removed terms by their kind, others by their shape."""
    found = find_spans(docs, id_col, text_col)
    spans = F.array_sort(F.concat(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))), "added"))
    known = staged(found.where(F.size("spans") > 0).select(F.col(id_col).alias("__id"), F.col("key").alias("__key"), spans.alias("__spans")).distinct(), "pii-sanitise")
    own = docs.withColumn("__own", F.xxhash64(F.col(id_col), F.col(text_col)))
    rows = own.join(known, (F.col("__own") == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    text = F.col(text_col)

    def shown(s: Column) -> Column:
        word = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, r"\p{Lu}", "X"), r"\p{Ll}", "x"), r"\p{N}", "9")
        return F.when(s["rank"] == 5, shape).otherwise(F.concat(F.lit("["), F.element_at(F.array(*[F.lit(k.upper()) for k in KINDS]), s["rank"] + 1), F.lit("]")))

    def step(s: Column, x: Column) -> Column:  # a span that starts inside the one before adds no text
        gap = F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.when(x["start"] >= s["at"], F.concat(gap, shown(x))).otherwise("")).alias("out"))

    clean = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(clean)).select(*docs.columns)
