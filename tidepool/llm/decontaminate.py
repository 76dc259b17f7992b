"""Benchmark decontamination with suffix arrays over the training words.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII
characters.  A window is ``width`` consecutive words of a benchmark item; an
item of fewer words, but not none, is one window.  Each Arrow batch of documents
is one shard: its words become numbers, the positions from which a window could
start are sorted by the words that follow (a suffix array, compared up to
``width`` words), and every test suffix that starts a window is binary-searched
in it.  The range found holds all its occurrences.

Where windows follow each other, the suffixes of both sides (of the document from
its hit positions, of the items from the windows found) are sorted in full by
prefix doubling: the nearest test suffix in that order gives the longest verbatim
match that starts at a position.  A match that the one a word earlier contains is
left out.  A document has at most one match for each place of a window, whatever
the number of items that hold it; the items are a set beside, gathered by the
distinct windows of the document.  Work and memory thus follow the words of the
shard and the items named, also in periodic texts and shared passages.

A benchmark is broadcast only in blocks of at most about ``BLOCK_BYTES`` of text;
of a larger one each block is worked off, its result written and its broadcast
dropped before the next.

Defined cases: null, empty and wordless texts have no words and no match, an
item without words no window; repeated documents and items are each matched;
items with a null identifier mark words but are not named; a match that several
items hold names one of them; an empty benchmark matches nothing.  Texts are
never cut; one document may fill a shard alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import staged, unstaged

WIDTH = 10
#: Benchmark text that is broadcast at once, at most.
BLOCK_BYTES = 16_000_000
MATCH = "struct<item_id:string,doc_start:int,item_start:int,n_words:int>"
_MATCH_PA = pa.struct([("item_id", pa.string()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("n_words", pa.int32())])

#: A-Z to a-z; all else outside 0-9, a-z and non-ASCII to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_FOLD).split() if raw else []


class TestWindows:
    """The distinct windows of a block of items, as rows of word numbers (from 1; 0 fills up).

    Every place of a window is one start (its item, its place there, its window),
    in the order of the items.  Windows held by equal sets of items share a set.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int = WIDTH):
        self.width, self.vocabulary = width, {}
        self.names = [name for name, _ in items]
        views, counts = [np.zeros((0, width), dtype=np.int32)], []
        for _, raw in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(raw)]
            row = np.array(ids + [0] * (width - len(ids) if ids else 0), dtype=np.int32)
            counts.append(len(row) - width + 1 if ids else 0)
            if ids:
                views.append(np.lib.stride_tricks.sliding_window_view(row, width))
        self.rows, of = np.unique(np.concatenate(views), axis=0, return_inverse=True)
        self.sizes = (self.rows > 0).sum(axis=1)
        self.least = int(self.sizes.min()) if len(self.rows) else 0
        counts = np.array(counts, dtype=np.int64)
        self.start_window = of.reshape(-1).astype(np.int64)
        self.start_item = np.repeat(np.arange(len(items)), counts)
        self.start_at = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.first_start = np.zeros(len(self.rows), dtype=np.int64)
        self.first_start[self.start_window[::-1]] = np.arange(len(of))[::-1]
        self._name_sets()

    def _name_sets(self) -> None:
        """For each window the number of its set of items; the sets end to end."""
        pairs = np.unique(np.stack([self.start_window, self.start_item], axis=1), axis=0) if len(self.start_item) else np.zeros((0, 2), dtype=np.int64)
        ends = np.cumsum(np.bincount(pairs[:, 0], minlength=len(self.rows)))
        known: dict[bytes, int] = {}
        sets, first = [], 0
        self.set_of = np.zeros(len(self.rows), dtype=np.int64)
        for w, end in enumerate(ends.tolist()):
            held = pairs[first:end, 1]
            self.set_of[w] = known.setdefault(held.tobytes(), len(known))
            if len(known) > len(sets):
                sets.append(held)
            first = end
        self.set_sizes = np.array([len(x) for x in sets], dtype=np.int64)
        self.set_items = np.concatenate([np.zeros(0, dtype=np.int64), *sets])
        self.set_first = np.cumsum(self.set_sizes) - self.set_sizes


def _ranges(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first … first + size - 1 of each range, end to end."""
    return np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def suffix_array(ids: np.ndarray, width: int, least: int) -> np.ndarray:
    """Positions with ``least`` known words ahead, sorted by the next ``width`` words.

    Zeros are unknown words and document ends; a suffix ends before one.
    """
    known = np.concatenate([[0], np.cumsum(ids[:len(ids) - width] > 0)])
    starts = np.flatnonzero(known[least:] - known[:len(known) - least] == least)
    view, keys = _ahead(ids, starts, width), []
    for k in range(0, width, 2):
        pair = view[:, k].astype(np.int64) << 32
        keys.append(pair | view[:, k + 1] if k + 1 < width else pair)
    return starts[np.lexsort(keys[::-1])] if len(starts) else starts


def _ahead(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The next words of each start, zero from the first unknown one on."""
    view = ids[starts[:, None] + np.arange(width)]
    return view * np.logical_and.accumulate(view > 0, axis=1)


def search(ids: np.ndarray, suffixes: np.ndarray, rows: np.ndarray, sizes: np.ndarray, after: bool) -> np.ndarray:
    """For each row the place of the first suffix not below it (``after``: above all that start with it)."""
    low, high = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), len(suffixes), dtype=np.int64)
    width = rows.shape[1]
    inside = np.arange(width) < sizes[:, None]
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        have = np.where(inside[open_], _ahead(ids, suffixes[middle], width), 0)
        differs = have != rows[open_]
        first = differs.argmax(axis=1)
        pick = np.arange(len(open_))
        below = have[pick, first] < rows[open_][pick, first]
        if after:
            below |= ~differs.any(axis=1)
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)


def _longest(symbols: np.ndarray, follows: np.ndarray, is_test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of, and the test place with, the longest common run of symbols.

    ``follows[k]`` says that place k + 1 continues place k.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    stops = np.flatnonzero(~follows)
    left = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n) + 1  # symbols up to the end of the stretch
    rank = np.unique(symbols, return_inverse=True)[1].reshape(-1).astype(np.int64) + 1
    levels, step = [rank], 1
    while step < left.max():
        ahead = np.where(left > step, rank[np.minimum(np.arange(n) + step, n - 1)], 0)
        rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].reshape(-1).astype(np.int64) + 1
        levels.append(rank)
        step *= 2

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        length = np.zeros(len(a), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
            more = (left[a] - length >= 1 << k) & (left[b] - length >= 1 << k) & (levels[k][x] == levels[k][y])
            length += more.astype(np.int64) << k
        return length

    order = np.argsort(rank, kind="stable")
    tests = np.where(is_test[order], np.arange(n), -1)
    before = np.maximum.accumulate(tests)
    after = n - 1 - np.maximum.accumulate(np.where(is_test[order], n - 1 - np.arange(n), -1)[::-1])[::-1]
    best, where = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for near in (before, after):
        has = (near >= 0) & (near < n)
        place, test = order[has], order[near[has]]
        length = common(place, test)
        better = length > best[place]
        best[place[better]], where[place[better]] = length[better], test[better]
    return best, where


def shard_matches(texts: list[bytes | None], test: TestWindows) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    """Number of words, longest matches and items of each text."""
    number, width = test.vocabulary.get, test.width
    parts, lengths = [], []
    for raw in texts:
        words = words_of(raw)
        lengths.append(len(words))
        parts.append(np.fromiter((number(w, 0) for w in words), dtype=np.int32, count=len(words)))
        parts.append(np.zeros(1, dtype=np.int32))
    matches: list[list[dict]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if not texts or not test.least:
        return lengths, matches, items
    ids = np.concatenate([*parts, np.zeros(width, dtype=np.int32)])
    firsts = np.cumsum([0, *(n + 1 for n in lengths)])
    suffixes = suffix_array(ids, width, test.least)
    low = search(ids, suffixes, test.rows, test.sizes, False)
    high = search(ids, suffixes, test.rows, test.sizes, True)
    found = np.flatnonzero(high > low)
    if not len(found):
        return lengths, matches, items
    places = suffixes[_ranges(low[found], high[found] - low[found])]
    windows = np.repeat(found, high[found] - low[found])
    owners = np.searchsorted(firsts, places, side="right") - 1

    # the items: those of each distinct set of the document's windows
    n_sets = len(test.set_sizes)
    named = np.unique(owners * n_sets + test.set_of[windows])
    sets = named % n_sets
    held = test.set_items[_ranges(test.set_first[sets], test.set_sizes[sets])]
    pairs = np.unique(np.repeat(named // n_sets, test.set_sizes[sets]) * len(test.names) + held)
    for doc, item in zip((pairs // len(test.names)).tolist(), (pairs % len(test.names)).tolist()):
        if test.names[item] is not None:
            items[doc].append(test.names[item])

    # the matches: windows of an item shorter than the width stand alone, the others may continue
    whole = test.sizes[windows] == width
    order = np.argsort(places[whole])
    place, window = places[whole][order], windows[whole][order]
    hit = np.zeros(len(test.rows), dtype=bool)
    hit[found] = True
    starts = np.flatnonzero(hit[test.start_window] & (test.sizes[test.start_window] == width))
    item_of = test.start_item[starts]
    follows = np.concatenate([np.diff(place) == 1, [False] * (len(place) > 0), (np.diff(starts) == 1) & (np.diff(item_of) == 0), [False] * (len(starts) > 0)]).astype(bool)
    length, where = _longest(np.concatenate([window, test.start_window[starts]]), follows, np.arange(len(place) + len(starts)) >= len(place))
    length, where = length[:len(place)], where[:len(place)] - len(place)
    inside = np.concatenate([[False], (np.diff(place) == 1) & (length[1:] == length[:-1] - 1)]) if len(place) else np.zeros(0, dtype=bool)
    at = np.concatenate([place[~inside], places[~whole]])
    start = np.concatenate([starts[where[~inside]], test.first_start[windows[~whole]]])
    size = np.concatenate([length[~inside] + width - 1, test.sizes[windows[~whole]]])
    order = np.lexsort((-size, at))
    docs = np.searchsorted(firsts, at[order], side="right") - 1
    rows = zip(docs.tolist(), (at[order] - firsts[docs]).tolist(), test.start_item[start[order]].tolist(), test.start_at[start[order]].tolist(), size[order].tolist())
    for doc, doc_start, item, item_start, n in rows:
        matches[doc].append({"item_id": test.names[item], "doc_start": doc_start, "item_start": item_start, "n_words": n})
    return lengths, matches, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark in pieces of bounded text, its rows dealt by number (equal items lie apart)."""
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(64))).first()[0] or 0
    n = -(-2 * size // BLOCK_BYTES) or 1  # half full on average
    named = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    if n == 1:
        return [named]
    dealt = staged(named.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))), "benchmark-blocks", by="block")
    return [dealt.where(F.col("block") == k).select("i", "t") for k in range(n)]


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 width: int = WIDTH, words_name: str = "n_words", matches_name: str = "matches", items_name: str = "items") -> DataFrame:
    """``docs`` with its number of words, its longest verbatim matches (array of structs) and the
    names of all items with an occurring window (array of distinct strings, except those of several blocks)."""
    spark = docs.sparkSession
    new_types = {words_name: "long", matches_name: f"array<{MATCH}>", items_name: "array<string>"}
    out = docs.drop(*new_types)
    out = out.withColumns({c: F.lit(None).cast(t) for c, t in new_types.items()})
    blocks, last = _blocks(benchmark, item_col, item_text_col), None
    for k, block in enumerate(blocks):
        test = spark.sparkContext.broadcast(TestWindows([(r.i, bytes(r.t) if r.t is not None else None) for r in block.collect()], width))
        raw = f"__raw_{k}"

        def run(batches: Iterator[pa.RecordBatch], raw=raw, test=test) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths, matches, items = shard_matches(batch.column(raw).to_pylist(), test.value)
                matches = [(a or []) + b for a, b in zip(batch.column(matches_name).to_pylist(), matches)]
                items = [(a or []) + b for a, b in zip(batch.column(items_name).to_pylist(), items)]
                new = {words_name: pa.array(lengths, pa.int64()), matches_name: pa.array(matches, pa.list_(_MATCH_PA)), items_name: pa.array(items, pa.list_(pa.string()))}
                names = [c for c in batch.schema.names if c != raw]
                yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)

        schema = out.schema
        out = out.withColumn(raw, F.col(text_col).cast("binary")).mapInArrow(run, schema)
        if len(blocks) > 1:
            out = staged(out, "benchmark-found")
            test.destroy()
            if last is not None:
                unstaged(last)
            last = out
    return out


def hit_words(matches) -> object:
    """Words inside any match: the length of the union of the matches' ranges."""
    ranges = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_start"].alias("a"), (m["doc_start"] + m["n_words"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(ranges, start, lambda s, r: F.struct(
        (s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["end"])).cast("long")).alias("n"),
        F.greatest(s["end"], r["b"]).alias("end")), lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, longest_match, the matches and the items."""
    found = find_matches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    matches = F.col("matches")
    items = F.array_sort(F.array_distinct("items"))
    hits = F.coalesce(hit_words(matches), F.lit(0).cast("long"))
    return found.select(
        F.col("doc_id").alias(id_col), "n_words", hits.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform(matches, lambda m: m["n_words"])), F.lit(0)).alias("longest_match"), "matches", items.alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without any match; their columns unchanged."""
    found = find_matches(docs, benchmark, text_col, words_name="__words", matches_name="__matches", items_name="__items")
    return found.where(F.size("__matches") == 0).select(*docs.columns)
