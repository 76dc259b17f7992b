"""A Bloom filter as two DataFrame steps: build by aggregation, test by a broadcast join.

The filter is a table (word, bits) of at most ``MAX_WORDS`` rows of two longs, whatever
the number of keys, so its broadcast has a fixed bound (about 32 MB).  A key
sets three bits of one word.  Rows that pass may be chance hits: the caller's own
join decides.  With more keys than the table was made for, more rows pass; the
result of the caller's join is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MAX_WORDS = 1 << 10, 1 << 20
#: Keys a word is made for (16 bits a key: about one chance hit in 200).
KEYS_A_WORD = 4


def words_for(bound: int | None) -> int:
    """Words for up to ``bound`` keys (None: not known)."""
    if bound is None:
        return MAX_WORDS
    return min(MAX_WORDS, max(MIN_WORDS, 1 << (bound // KEYS_A_WORD).bit_length()))


def _place(cols: list[Column], words: int) -> tuple[Column, Column]:
    """(word, mask of three bits) of a key."""
    bits = F.xxhash64(F.lit(1), *cols)
    one = F.lit(1).cast("long")
    mask = F.lit(0).cast("long")
    for at in (0, 6, 12):
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, F.shiftright(bits, at).bitwiseAND(63).cast("int")))
    return F.pmod(F.xxhash64(*cols), F.lit(words)).cast("long"), mask


def bloom_of(keys: DataFrame, cols: list[str], words: int) -> DataFrame:
    """The filter (word, bits) of the rows' keys; keys with a null are not in it."""
    word, mask = _place([F.col(c) for c in cols], words)
    return keys.select(*cols).na.drop().select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))


def might_hold(big: DataFrame, bloom: DataFrame, cols: list[str], words: int) -> DataFrame:
    """Rows of ``big`` whose key may be in the filter; tested where ``big`` is scanned, without a shuffle of it."""
    word, mask = _place([F.col(c) for c in cols], words)
    tested = big.withColumn("_word", word).join(F.broadcast(bloom), "_word")
    return tested.where(F.col("_bits").bitwiseAND(mask) == mask).select(*big.columns)
