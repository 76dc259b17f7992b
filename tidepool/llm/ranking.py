"""Ranked lexical search by dense blocked matrix multiplication.

Items (the queries) are taken in blocks of bounded size.  A block's distinct terms are
its vocabulary.  One pass over the documents cuts each whole text into words and keeps
the counts of the block's terms; their document frequencies, the number of documents N
and of terms L are sums over that table.

Scores.  A second pass takes documents in tiles.  For every tile of the vocabulary a
matrix (items x terms) of counts is multiplied by a matrix (terms x documents) of
impacts in float64, by BLAS.  Impacts and counts are integers, and the vocabulary is cut
where the sum of an item's products could reach 2**53, so every partial sum is exact;
tiles are added up as 64-bit integers.

Top k.  A task keeps, for each item, the k best of what it has seen: the k-th largest
score is found, everything not below it is kept (ties included), and ties are then cut
by ascending identifier.  The tasks' results meet in a window by item.

What a worker holds is bounded by the block of items and the tile of documents, never
by the number of documents or of items.

Defined cases: a null text has no terms and is never found; N counts documents with a
term only.  An item without terms, or null, finds nothing.  Repeated rows of documents
are ranked each for itself; repeated items are answered each for itself (the same
rows again).  A null document identifier comes last among ties.  Scores of 0 are no
match.  Empty tables give an empty result.  Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import staged
from .words import byte_table, words

#: Items and bytes of item text that make a block, at most (one item at least).
BLOCK_ITEMS, BLOCK_BYTES = 1_024, 4_000_000
#: Terms and documents of a tile.
TILE_TERMS, TILE_DOCS = 2_048, 1_024
EXACT = 2 ** 53
_NULL_ID = np.iinfo(np.int64).max

_TERM_BYTES = [c for c in range(256) if c >= 0x80 or chr(c).isalnum()]
_TABLE = byte_table(_TERM_BYTES)


class Block:
    """A block of items: their identifiers, term counts, and the vocabulary they share."""

    def __init__(self, items: list[tuple], texts: list[str | None]):
        self.items = items
        rows, terms, counts, names = [], [], [], {}
        for block in words((t.encode() if t is not None else None for t in texts), _TABLE):
            for i, s, e in zip(block.text.tolist(), block.start.tolist(), block.end.tolist()):
                rows.append(i)
                terms.append(names.setdefault(block.norm[s:e].tobytes(), len(names)))
        self.counts = Counter(zip(rows, terms))
        self.names = list(names)
        # one word's hash, by the same function that hashes the documents' words
        hashes = np.array([int(b.hash[0]) for name in self.names for b in words([name], _TABLE)], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def find(self, block) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms) of a layout's words that are in the vocabulary."""
        if not len(self.hashes) or not len(block):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, block.hash), len(self.hashes) - 1)
        places = np.flatnonzero(self.hashes[at] == block.hash)
        found = self.order[at[places]]
        # a hash that another word shares: the first occurrence of each term is compared by its bytes
        seen, first = np.unique(found, return_index=True)
        for term, p in zip(seen.tolist(), places[first].tolist()):
            if block.norm[block.start[p]:block.end[p]].tobytes() != self.names[term]:
                same = [block.norm[s:e].tobytes() == self.names[term] for s, e in zip(block.start[places[found == term]], block.end[places[found == term]])]
                keep = np.ones(len(places), dtype=bool)
                keep[np.flatnonzero(found == term)[~np.array(same)]] = False
                places, found = places[keep], found[keep]
        return places, found

    def tiles(self, weights: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, counts by item and term) with exact products; a very frequent term may fill several columns."""
        top = max(weights, default=0) * 1_000_000 + 1
        most = max(1, (EXACT - 1) // top)  # occurrences of an item whose products still add up exactly
        columns: list[tuple[int, dict[int, int]]] = []
        by_term: dict[int, dict[int, int]] = {}
        for (item, term), c in self.counts.items():
            by_term.setdefault(term, {})[item] = c
        for term in range(len(self.names)):
            left = dict(by_term[term])
            while left:
                columns.append((term, {i: min(c, most) for i, c in left.items()}))
                left = {i: c - most for i, c in left.items() if c > most}
        made, held, load = [], [], Counter()
        for term, own in columns:
            if held and (len(held) == TILE_TERMS or any(load[i] + c > most for i, c in own.items())):
                made.append(held)
                held, load = [], Counter()
            held.append((term, own))
            load.update(own)
        if held:
            made.append(held)
        found = []
        for tile in made:
            q = np.zeros((len(self.items), len(tile)))
            for k, (_, own) in enumerate(tile):
                for i, c in own.items():
                    q[i, k] = c
            found.append((np.array([t for t, _ in tile]), q))
        return found


def blocks_of(items: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """The items in blocks; the driver holds one block at a time."""
    held, texts, size = [], [], 0
    for row in items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).toLocalIterator():
        length = len(row["text"] or "")
        if held and (len(held) == BLOCK_ITEMS or size + length > BLOCK_BYTES):
            yield Block(held, texts)
            held, texts, size = [], [], 0
        held.append(row["item"])
        texts.append(row["text"])
        size += length
    if held:
        yield Block(held, texts)


def term_counts(docs: DataFrame, block: Block, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: identifier, number of terms, and the block's terms in it with their counts."""
    held = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            n = batch.num_rows
            totals = np.zeros(n, dtype=np.int64)
            keys = [np.empty(0, np.int64)]
            width = max(1, len(own.names))
            for block in words(batch["text"].to_pylist(), _TABLE):
                totals += np.bincount(block.text, minlength=n)
                places, terms = own.find(block)
                keys.append(block.text[places] * width + terms)
            key, tf = np.unique(np.concatenate(keys), return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(n + 1) * width), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(totals), pa.ListArray.from_arrays(offsets, pa.array(key % width, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], ["id", "n", "terms", "tf"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, "id long, n long, terms array<int>, tf array<long>")


def _frequencies(counts: DataFrame, size: int) -> tuple[list[int], int, int]:
    """(document frequency of each term of the block, N, L)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            df += np.bincount(batch["terms"].flatten().to_numpy(), minlength=size)
            own = batch["n"].to_numpy()
            n, total = n + int((own > 0).sum()), total + int(own.sum())
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], term]), pa.int32()), pa.array(np.concatenate([[n, total], df[term]]), pa.int64())], ["term", "count"])

    rows = counts.select("n", "terms").mapInArrow(run, "term int, count long").groupBy("term").agg(F.sum("count").alias("count"))
    found = {r["term"]: r["count"] for r in rows.toLocalIterator()}  # as many rows as the block has terms, at most
    return [found.get(t, 0) for t in range(size)], found.get(-2, 0), found.get(-1, 0)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest positive scores; equal scores by ascending identifier."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _scored(block: Block, weights: list[int], n_docs: int, n_terms: int, k: int):
    tiles = block.tiles(weights)
    weight = np.array(weights, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(block.items)
        column = np.full(len(block.names) + 1, -1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(at, TILE_DOCS)
                ids = part["id"].fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
                n = part["n"].to_numpy()
                m = 75 + (25 * n * n_docs) // max(1, n_terms)
                terms, tf = part["terms"].flatten().to_numpy(), part["tf"].flatten().to_numpy()
                doc = np.repeat(np.arange(len(n)), part["terms"].value_lengths().to_numpy())
                impact = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                scores = np.zeros((len(block.items), len(n)), dtype=np.int64)
                for own, q in tiles:
                    matrix = np.zeros((len(own), len(n)))
                    # a term may fill several columns, each in a pass of its own
                    for start in _runs(own):
                        column[own[start]] = start
                        hit = column[terms] >= 0
                        matrix[column[terms[hit]], doc[hit]] = impact[hit]
                        column[own[start]] = -1
                    scores += (q @ matrix).astype(np.int64)
                for item in np.flatnonzero(scores.max(axis=1, initial=0) > 0).tolist():
                    s = np.concatenate([top[item][0], scores[item]])
                    i = np.concatenate([top[item][1], ids])
                    keep = best(s, i, k)
                    top[item] = (s[keep], i[keep])
        sizes = [len(s) for s, _ in top]
        ids = np.concatenate([i for _, i in top]) if top else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(top), dtype=np.int32), sizes), pa.int32()), pa.array(ids, pa.int64(), mask=ids == _NULL_ID),
             pa.array(np.concatenate([s for s, _ in top]) if top else np.empty(0, np.int64), pa.int64())], ["item", "id", "score"])

    return run


def _runs(own: np.ndarray) -> list[np.ndarray]:
    """Column numbers of a tile, in groups in which no term comes twice."""
    seen: dict[int, int] = {}
    groups: dict[int, list[int]] = {}
    for column, term in enumerate(own.tolist()):
        seen[term] = seen.get(term, -1) + 1
        groups.setdefault(seen[term], []).append(column)
    return [np.array(g) for g in groups.values()]


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's k best documents."""
    spark = docs.sparkSession
    item_type = items.schema[item_id].dataType.simpleString()
    parts = []
    for block in blocks_of(items, item_id, text_col):
        counts = staged(term_counts(docs, block, doc_id, text_col), "ranking-counts")
        df, n_docs, n_terms = _frequencies(counts, len(block.names))
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df]
        found = counts.where(F.size("terms") > 0).mapInArrow(_scored(block, weights, n_docs, n_terms, k), "item int, id long, score long")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.items)), f"item int, item_id {item_type}")
        parts.append(staged(top.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score"), "ranking-block"))
    if not parts:
        parts.append(spark.createDataFrame([], f"item_id {item_type}, rank int, id long, score long"))
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result.select(F.col("item_id").alias(item_id), "rank", F.col("id").alias(doc_id), "score")
