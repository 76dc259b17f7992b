"""Token counts by heap-and-linked-list byte-pair merging.

A text is a sequence of symbols (characters, white space written as U+2581).
The adjacent pair whose concatenation has the lowest rank in the vocabulary is
merged again and again, the leftmost first on equal ranks.  A heap yields the
next pair, a doubly linked list the neighbours, and stale heap entries are
skipped.  Only the count is kept: initial symbols minus merges, plus the extra
bytes of characters the vocabulary lacks.  No token identifier is produced.

No vocabulary entry spans certain places, such as a word start (see
``_unit_pattern``), so texts fall apart there into units whose counts add up.  A unit's count is remembered by the worker, in a table of
bounded size.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted one by one; texts are never cut, split by words only.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SPACE = "▁"
#: Units a worker remembers; the table starts anew beyond it.
CACHE_UNITS = 1_000_000
#: Units of more characters are not remembered.
CACHE_CHARS = 64
#: Units that are merged side by side, and the rank of what is no pair.
BATCH_UNITS, NO_PAIR = 1 << 14, 1 << 40


def _unit_pattern(pieces) -> str:
    """A pattern whose matches, in order, make up a text and never share a vocabulary entry.

    Cuts lie before a word start, around characters that stand in no longer
    entry, and after letters that only letters follow in all entries.
    """
    inside = {c for piece in pieces if len(piece) > 1 for c in piece}
    alone = {chr(c) for c in range(128)} - inside - {" "}
    letters = {chr(c) for c in range(0x250) if chr(c).isalpha()} - alone
    pairs = {(a, b) for piece in pieces for a, b in zip(piece, piece[1:])}
    while open_ended := {a for a, b in pairs if a in letters and b not in letters}:
        letters -= open_ended
    escaped = lambda chars: "".join(re.escape(c) for c in sorted(chars))
    apart, kept = escaped(alone), escaped(letters)
    other = f"[^{SPACE}{apart}{kept}]"
    word = f"{other}*[{kept}]+|{other}+" if kept else f"{other}+"
    return f"{SPACE}*(?:{word})|{SPACE}+" + (f"|[{apart}]" if apart else "")


class PieceCounter:
    """Counts tokens of texts under a sentencepiece BPE model file."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if model.normalize("ﬁ  a") != f"{SPACE}ﬁ{SPACE * 2}a":
            raise ValueError("only identity normalisation with a leading space is handled")
        scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
                  if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        places = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks: dict[str, int] = {piece: places[score] for piece, score in scores.items()}
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.ranks):
            raise ValueError("a vocabulary entry spans a word start")
        self.units = re.compile(_unit_pattern(self.ranks))
        self.known: dict[str, int] = {}

    def merge_count(self, unit: str) -> int:
        """Tokens of one unit: its symbols minus the merges made."""
        rank_of, n = self.ranks.get, len(unit)
        symbols: list[str | None] = list(unit)
        heap = [rank * n + i for i in range(n - 1) if (rank := rank_of(unit[i:i + 2])) is not None]
        merges = 0
        if heap:
            heapq.heapify(heap)
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            while heap:
                rank, left = divmod(heapq.heappop(heap), n)
                head, right = symbols[left], after[left]
                if head is None or right >= n:
                    continue
                pair = head + symbols[right]
                if rank_of(pair) != rank:  # one side has grown since
                    continue
                symbols[left], symbols[right] = pair, None
                merges += 1
                follower, previous = after[right], before[left]
                after[left] = follower
                if follower < n:
                    before[follower] = left
                    if (rank := rank_of(pair + symbols[follower])) is not None:
                        heapq.heappush(heap, rank * n + left)
                if previous >= 0 and (rank := rank_of(symbols[previous] + pair)) is not None:
                    heapq.heappush(heap, rank * n + previous)
        ranks = self.ranks
        lacking = sum(len(s.encode()) - 1 for s in symbols if s is not None and s not in ranks)
        return n - merges + lacking

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for unit in self.units.findall(SPACE + text.replace(" ", SPACE)):
            tokens = known.get(unit)
            if tokens is None:
                tokens = self.merge_count(unit)
                if len(unit) <= CACHE_CHARS:
                    if len(known) >= CACHE_UNITS:
                        known.clear()
                    known[unit] = tokens
            total += tokens
        return total


class BatchCounter:
    """The counts of :class:`PieceCounter` for many texts at once.

    The new words of a batch are counted side by side: in every round each unit merges its lowest-ranked pair, the leftmost on
    equal ranks.  Units that are long or hold a character the vocabulary lacks go to :meth:`PieceCounter.merge_count`.
    """

    def __init__(self, model_path: str):
        self.single = PieceCounter(model_path)
        ranks = self.single.ranks
        ids = {piece: k for k, piece in enumerate(ranks)}
        self.stride = len(ids)
        parts = sorted((ids[piece[:k]] * self.stride + ids[piece[k:]], rank, ids[piece])
                       for piece, rank in ranks.items() for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids)
        self.pairs, self.pair_ranks, self.merged = (np.array(x, dtype=np.int64) for x in zip(*parts))
        alphabet = [c for c in ids if len(c) == 1 and c != "\0"]
        self.id_of = np.full(max(map(ord, alphabet)) + 2, -1, dtype=np.int64)
        self.id_of[[ord(c) for c in alphabet]] = [ids[c] for c in alphabet]
        self.spans = re.compile(f"{SPACE}+[^{SPACE}]*")  # a word start, as often as it comes, and what follows
        self.words: dict[str, int] = {}  # without the word start

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; ``NO_PAIR`` where they make no vocabulary entry or one is missing (-1)."""
        keys = left * self.stride + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((self.pairs[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], NO_PAIR)

    def _merged(self, units: list[str], width: int) -> np.ndarray:
        """Tokens of units of at most ``width`` characters; -1 where the vocabulary lacks one."""
        codes = np.array(units, dtype=f"<U{width}").view("<u4").reshape(-1, width)
        symbols = self.id_of[np.minimum(codes, len(self.id_of) - 1)]
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        tokens = np.where((symbols >= 0).sum(axis=1) == sizes, sizes, -1)
        rows = np.flatnonzero(tokens > 1)
        symbols = np.pad(symbols[rows], ((0, 0), (0, 1)), constant_values=-1)
        ranks = np.pad(self._ranked(symbols[:, :-1], symbols[:, 1:]), ((0, 0), (0, 1)), constant_values=NO_PAIR)
        columns = np.arange(width + 1)
        while True:
            at = ranks.argmin(axis=1)
            live = np.flatnonzero(ranks[np.arange(len(rows)), at] < NO_PAIR)
            if not len(live):
                return tokens
            rows, at, symbols, ranks = rows[live], at[live], symbols[live], ranks[live]
            own = np.arange(len(rows))
            tokens[rows] -= 1
            made = self.merged[np.searchsorted(self.pairs, symbols[own, at] * self.stride + symbols[own, at + 1])]
            kept = np.minimum(columns + (columns > at[:, None]), width)  # the right one goes, the last column is empty
            symbols, ranks = np.take_along_axis(symbols, kept, axis=1), np.take_along_axis(ranks, kept, axis=1)
            symbols[own, at] = made
            ranks[own, at] = self._ranked(made, symbols[own, at + 1])
            inner = np.flatnonzero(at)
            ranks[inner, at[inner] - 1] = self._ranked(symbols[inner, at[inner] - 1], made[inner])

    def unit_counts(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit."""
        tokens = np.full(len(units), -1, dtype=np.int64)
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        for width in range(4, CACHE_CHARS + 1, 4):
            own = np.flatnonzero((sizes <= width) & (sizes > width - 4))
            for at in range(0, len(own), BATCH_UNITS):
                part = own[at:at + BATCH_UNITS]
                tokens[part] = self._merged([units[k] for k in part.tolist()], width)
        for k in np.flatnonzero(tokens < 0).tolist():
            tokens[k] = self.single.merge_count(units[k])
        return tokens

    def word_counts(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of a word start and what follows it, for each of the words."""
        odd = [w for w in words if not w or SPACE in w]
        plain = [w for w in words if w and SPACE not in w]
        parts = self.single.units.findall("".join(SPACE + w for w in plain))  # each word's first unit begins with the word start
        place = {unit: k for k, unit in enumerate(dict.fromkeys(parts))}
        at = np.fromiter(map(place.__getitem__, parts), dtype=np.int64, count=len(parts))
        heads = np.flatnonzero(np.fromiter((unit[0] == SPACE for unit in place), dtype=bool, count=len(place))[at])
        counts = dict(zip(plain, np.add.reduceat(self.unit_counts(list(place))[at], heads).tolist())) if plain else {}
        return counts | {w: int(self.unit_counts(self.single.units.findall(SPACE + w)).sum()) for w in odd}

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        if len(self.words) >= CACHE_UNITS:
            self.words.clear()
        totals, fresh = [], []
        for text in texts:
            if not text:
                words = []
            elif "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
                words = [w[1:] for w in self.spans.findall(SPACE + text.replace(" ", SPACE))]
            else:
                words = text.split(" ")
            known = list(map(self.words.get, words))
            fresh.append([w for w, n in zip(words, known) if n is None] if None in known else [])
            totals.append(sum(filter(None, known)))
        found = self.word_counts(set().union(*fresh))
        self.words.update((word, n) for word, n in found.items() if len(word) <= CACHE_CHARS)
        return [total + sum(map(found.__getitem__, words)) for total, words in zip(totals, fresh)]


@functools.lru_cache(maxsize=2)
def _batch_counter(model_path: str) -> BatchCounter:
    return BatchCounter(model_path)


def batch_token_count(text: Column, model_path: str) -> Column:
    """As :func:`token_count`, the words of many texts at once."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(_batch_counter(model_path).counts(texts), dtype="int64")

    return counted(text)


@functools.lru_cache(maxsize=2)
def _counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def token_count(text: Column, model_path: str) -> Column:
    """Tokens of each whole text; 0 for null and empty."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        count = _counter(model_path).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Columns of these names that ``docs`` already has are replaced.
    """
    text = F.col(text_col)
    return docs.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
        "n_tokens": token_count(text, model_path),
    }).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
