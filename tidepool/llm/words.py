"""Words of many texts at once: their hashes, places and normalised bytes, by numpy.

A batch of UTF-8 texts is laid out in one byte array.  A table of 256 entries says
what a word is made of (all three operators that use this cut words at ASCII bytes
only, so bytes tell words apart as well as code points do), and every word gets a
64-bit hash from prefix sums of a polynomial, without a Python step per word.

The hash of a word depends on its bytes alone, never on its place or batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

#: Bytes of text that are laid out at once (a longer word is laid out whole).
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and its inverse's, modulo 2**64."""
    def upto(base: int) -> np.ndarray:
        factors = np.full(n, base, dtype=np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)

    return upto(_BASE), upto(pow(_BASE, -1, 1 << 64))


def byte_table(word: Iterable[int], breaks: Iterable[int] = ()) -> tuple[bytes, np.ndarray]:
    """(translation that lower-cases A-Z, class of each byte: 1 word, 0 gap, 2 gap that ends a piece)."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[list(word)] = 1
    kind[list(breaks)] = 2
    return bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)), kind


class Words:
    """Words of a block: ``norm[start[i]:end[i]]`` is word i, and one space follows each in ``norm``."""

    __slots__ = ("norm", "start", "end", "hash", "text", "piece")

    def __init__(self, norm, start, end, hashes, text, piece):
        self.norm, self.start, self.end, self.hash, self.text, self.piece = norm, start, end, hashes, text, piece

    def __len__(self) -> int:
        return len(self.start)


def _layout(parts: list[tuple[int, bytes]], table: tuple[bytes, np.ndarray]) -> Words:
    lower, kind = table
    raw = np.frombuffer(b"\n".join(p for _, p in parts).translate(lower) + b"\n", dtype=np.uint8)
    kinds = kind[raw]
    word = kinds == 1
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = word.copy()
    keep[last] = True  # the gap byte after a word stays, as its space
    norm = np.where(word, raw, _SPACE)[keep].astype(np.uint8)
    length = last - first
    end = np.cumsum(length + 1) - 1
    start = end - length
    ends_of_text = np.cumsum([len(p) + 1 for _, p in parts])
    owner = np.searchsorted(ends_of_text, first, side="right")
    piece = np.cumsum(kinds == 2, dtype=np.int64)[first] + owner if len(first) else first
    power, inverse = _powers(1 << max(20, (len(norm) + 1).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[norm] * power[:len(norm)], dtype=np.uint64)])
    hashes = mix(((sums[end] - sums[start]) * inverse[start]) ^ (length.astype(np.uint64) << np.uint64(40)))
    return Words(norm, start, end, hashes, np.array([i for i, _ in parts], dtype=np.int64)[owner], piece)


def _cut(text: bytes, gaps: bytes, block: int) -> Iterator[bytes]:
    """Parts of a long text, each of about ``block`` bytes and ending behind a byte of ``gaps``."""
    at = 0
    while len(text) - at > block:
        stop = -1
        reach = block
        while stop < 0 and at + reach < len(text):  # a part never ends within a word
            stop = max(text.rfind(bytes([g]), at, at + reach) for g in gaps)
            reach *= 2
        if stop < 0:
            break
        yield text[at:stop + 1]
        at = stop + 1
    yield text[at:]


def words(texts: Iterable[bytes | None], table: tuple[bytes, np.ndarray], cut_at_breaks: bool = False, block: int = BLOCK) -> Iterator[Words]:
    """The words of all texts, block by block; ``text`` numbers the texts.

    A text of over ``block`` bytes is spread over several blocks, cut between
    words, or with ``cut_at_breaks`` between pieces only.
    """
    kind = table[1]
    gaps = bytes(np.flatnonzero(kind == 2 if cut_at_breaks else kind != 1).astype(np.uint8))
    held: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for part in _cut(text or b"", gaps, block):
            if held and size + len(part) > block:
                yield _layout(held, table)
                held, size = [], 0
            held.append((i, part))
            size += len(part) + 1
    if held:
        yield _layout(held, table)


def slices(norm: np.ndarray, start: np.ndarray, end: np.ndarray):
    """An Arrow string array of ``norm[start[i]:end[i]]``."""
    import pyarrow as pa

    length = end - start
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(norm[at])))
    return found.cast(pa.string())
