"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A line is a piece between line feeds; its hash is its MD5.  Every window of
``WINDOW`` consecutive lines of a document is represented by its smallest hash, and
counts where that is not a blank line's.  The fingerprint of a window is the window
as its minimum finds it: a run of WINDOW lines that two places share is a whole
window at both, so each such run is found, whatever precedes or follows it.  Shorter
runs have a fingerprint where they hold ``LONG_CHARS`` characters.

Fingerprints are joined with their first place: the smallest (document, position).
Those found elsewhere are matches; matches that touch or overlap are one run, which
so extends both ways as far as windows repeat.  Runs are deleted; a line stays where
no run with an earlier equal place holds it, so the first place of a line stays.

Only fingerprints (two longs and a place) are shuffled, by their hash, then matches
by document.  Each occurrence meets one first place, never all others, so a line
that many documents share costs one row each.

Defined cases: null and empty texts stay as they are; blank lines alone are no run,
but belong to runs; documents come in the order of their identifiers,
null first, ties by a hash of the text; repeated rows (same identifier and text)
are one document and get the same result; a document all of whose lines repeat
is left with the empty text.  Texts are never cut; ``n_deleted`` counts lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import staged

WINDOW = 2
LONG_CHARS = 40
#: Sorts after every MD5: a blank line's stand-in.
_LAST = "f" * 33


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.when(F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")) == "", F.lit(_LAST)).otherwise(F.md5(line.cast("binary")))


def fingerprints(docs: DataFrame, window: int = WINDOW, long_chars: int = LONG_CHARS) -> DataFrame:
    """The fingerprints (id, key, pos, size, k1, k2) of the documents (id, key, text).

    One for each window of ``window`` lines whose smallest hash is not a blank
    line's, and one for each shorter run of ``long_chars`` characters or more.
    """
    at = docs.where(F.length("text") > 0).select("id", "key", _lines(F.col("text")).alias("lines"))
    at = at.select("id", "key", F.transform("lines", _hash).alias("hs"), F.transform("lines", lambda x: F.length(x)).alias("ns"))
    n = F.size("hs")

    def of(size: int) -> Column:
        starts = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))

        def wanted(s: Column) -> Column:
            lines = F.slice("hs", s + 1, F.lit(size))
            some = F.array_min(lines) != _LAST
            if size == window:
                return some
            return some & (F.aggregate(F.slice("ns", s + 1, F.lit(size)), F.lit(0).cast("long"), lambda t, x: t + x) >= long_chars)

        def made(s: Column) -> Column:
            lines = F.slice("hs", s + 1, F.lit(size))
            return F.struct(s.alias("pos"), F.lit(size).alias("size"), F.xxhash64(lines).alias("k1"), F.xxhash64(F.lit(size), lines).alias("k2"))

        return F.transform(F.filter(starts, wanted), made)

    return at.select("id", "key", F.explode(F.flatten(F.array(*[of(k) for k in range(1, window + 1)]))).alias("f")).select("id", "key", "f.*")


def _merged(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Numbers, as ``run``, the ranges (lo, hi) of a group that overlap or touch."""
    order = Window.partitionBy(*by).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("new", (F.coalesce(reach, F.lit(-2)) < F.col("lo") - 1).cast("int")).withColumn("run", F.sum("new").over(order))


def deleted_runs(docs: DataFrame, window: int = WINDOW, long_chars: int = LONG_CHARS) -> DataFrame:
    """(id, key, runs): for each document with later repeated runs their line ranges, sorted, disjoint."""
    found = staged(fingerprints(docs, window, long_chars), "lines-fingerprints")
    first = staged(found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key", "pos")).alias("first"))
                   .where("n > 1").select("k1", "k2", "first"), "lines-first")
    at_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key")) & (F.col("pos") == F.col("first.pos"))
    matches = found.join(first, ["k1", "k2"]).where(~at_first).select("id", "key", F.col("pos").alias("lo"), (F.col("pos") + F.col("size") - 1).alias("hi")).distinct()
    whole = _merged(staged(matches, "lines-matches"), ["id", "key"]).groupBy("id", "key", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return whole.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, long_chars: int = LONG_CHARS,
                n_lines: str = "n_lines", n_deleted: str = "n_deleted") -> DataFrame:
    """``docs`` with later repeated runs cut out of the text, and the numbers of lines and deleted lines."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    runs = staged(deleted_runs(docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text")), window, long_chars)
                  .select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("runs").alias("__runs")), "lines-runs")
    names = docs.columns
    keyed = docs.withColumn("__own", key)
    joined = keyed.join(runs, (F.col("__own") == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    lines, m = _lines(F.col(text_col)), F.size("__runs")
    # what lies between two deleted runs, before the first and after the last
    kept = F.flatten(F.transform(F.sequence(F.lit(0), m), lambda i: F.slice(
        F.col("__lines"), F.when(i > 0, F.get("__runs", i - 1)["hi"] + 2).otherwise(1),
        F.when(i < m, F.get("__runs", i)["lo"]).otherwise(F.size("__lines")) - F.when(i > 0, F.get("__runs", i - 1)["hi"] + 1).otherwise(0))))
    gone = F.aggregate("__runs", F.lit(0), lambda s, r: s + r["hi"] - r["lo"] + 1)
    counted = joined.withColumn("__lines", lines)
    others = [F.col(c) for c in names if c not in {text_col, n_lines, n_deleted}]
    text = F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias(text_col)
    return counted.select(*others, text, F.when(F.length(text_col) > 0, F.size("__lines")).otherwise(0).cast("long").alias(n_lines),
                          F.coalesce(gone, F.lit(0)).cast("long").alias(n_deleted)).select(*[c for c in names if c not in {n_lines, n_deleted}], n_lines, n_deleted)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with later repeated runs cut out; those that lose all their lines go."""
    done = dedup_lines(docs, id_col, text_col, n_lines="__n_lines", n_deleted="__n_deleted")
    return done.where((F.col("__n_deleted") == 0) | (F.col("__n_deleted") < F.col("__n_lines"))).select(*docs.columns)
