"""Phrase collocations by dynamic itemset counting over cyclic scans of shards.

Texts are dealt into ``shards`` written once.  Step t scans shard t mod ``shards`` and
counts all active phrases of all lengths at once:

* every word is active from the first step on;
* a longer phrase becomes active as soon as both its subphrases (without its last and
  without its first word) have reached the threshold in what has been counted so far;
* an active phrase is counted for one full cycle, so once in every shard, and is then
  complete; below the threshold it is dropped.

The scans end when nothing shorter than the longest phrase has reached the threshold
within a cycle.  As no phrase is more frequent than its subphrases, every phrase that
reaches the threshold has been active, and its count is exact.

The counts lie in a written table that each step replaces.  What the scanning tasks need
of it is a table of fixed size (``slots`` bytes, broadcast): a subphrase that reached the
threshold in step s sets two slots, found by its hash, to s + 1.  A phrase whose
subphrases find both their slots set is taken as active from the largest of those steps
on.  Chance hits can only make a phrase active that need not be, or a cycle start anew;
they cost counting, never change a count: a phrase is always emitted for a whole cycle
from the first step it is taken as active, and a shard's count is added once (``seen``
holds the shards that were added).  With more phrases than slots the scans count more,
with the same result.

A phrase's cuts, scores and redundancy are joins of the table of frequent phrases with
itself; scores are exact in 38-digit decimals.

Defined cases: null and empty texts hold no words; a null language is ``und``.  Repeated
rows count each.  Empty tables give an empty result.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import staged, unstaged
from .words import byte_table, mix, slices, words

SHARDS, SLOTS = 3, 1 << 24
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = byte_table((c for c in range(256) if c not in _BREAKS + b" \t"), _BREAKS)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _language_hashes(langs: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], dtype=np.uint64)


def _slots(hashes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes % np.uint64(slots)).astype(np.int64), ((hashes >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)


def _scan(table: np.ndarray, step: int, shards: int, longest: int):
    """Arrow batches (lang, text) to the counts (lang, length, phrase, count) of active phrases; length 0 counts all words."""
    slots = len(table)

    def reached(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The step + 1 from which each phrase is taken as frequent (0: not yet)."""
        found = np.zeros(len(hashes), dtype=np.int16)
        one, two = (table[x] for x in _slots(hashes[at], slots))
        found[at] = np.where((one > 0) & (two > 0), np.maximum(one, two), 0)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            salts = _language_hashes(names)
            for block in words(batch["text"].to_pylist(), _TABLE, cut_at_breaks=True):
                if not len(block):
                    continue
                code = codes[block.text]

                def rows(length: int, hashes: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
                    _, first, count = np.unique(hashes[at], return_index=True, return_counts=True)
                    p = at[first]
                    return pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.string()).take(pa.array(code[p])), pa.array(np.full(len(p), length, dtype=np.int32)),
                         slices(block.norm, block.start[p], block.end[p + max(length, 1) - 1]), pa.array(count.astype(np.int64))],
                        ["lang", "length", "phrase", "count"])

                hashes = mix(block.hash ^ salts[code])
                if step < shards:
                    own = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[c] for c in own[0]], pa.string()), pa.array(np.zeros(len(own[0]), dtype=np.int32)),
                         pa.array([""] * len(own[0]), pa.string()), pa.array(own[1].astype(np.int64))], ["lang", "length", "phrase", "count"])
                    yield rows(1, hashes, np.arange(len(block)))
                since = reached(hashes, np.arange(len(block)))
                for length in range(2, longest + 1):
                    n = len(block) - length + 1
                    if n <= 0:
                        break
                    whole = block.piece[:n] == block.piece[length - 1:]
                    both = whole & (since[:n] > 0) & (since[1:n + 1] > 0)
                    at = np.flatnonzero(both)
                    if not len(at):
                        break
                    hashes = mix(hashes[:n] * _STEP + block.hash[length - 1:])
                    active = at[np.maximum(since[at], since[at + 1]) >= step - shards + 1]
                    if len(active):
                        yield rows(length, hashes, active)
                    since = reached(hashes, at)
    return run


def _new_slots(slots: int):
    """Frequent phrases (lang, length, phrase) to the slots they set, 64 to a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            salts = _language_hashes(batch["lang"].to_pylist())
            parts = list(words((p.encode() for p in batch["phrase"].to_pylist()), _TABLE))
            each, text = np.concatenate([b.hash for b in parts]), np.concatenate([b.text for b in parts])
            first = np.searchsorted(text, np.arange(batch.num_rows))
            length = batch["length"].to_numpy()
            hashes = mix(each[first] ^ salts)
            for k in range(1, int(length.max())):
                longer = np.flatnonzero(length > k)
                hashes[longer] = mix(hashes[longer] * _STEP + each[first[longer] + k])
            slot = np.unique(np.concatenate(_slots(hashes, slots)))
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array((np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])
    return run


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text",
                     shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Rows (lang, length, phrase, total) of all phrases found ``least`` times or more; length 0 counts a language's words."""
    if not 1 < shards < 63:
        raise ValueError("shards must lie between 2 and 62")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    dealt = staged(texts.where("length(text) > 0").withColumn("shard", F.floor(F.rand(7) * shards).cast("int")), "phrases-shards", by="shard")
    table = np.zeros(slots, dtype=np.uint8)
    names = ["lang", "length", "phrase"]
    state: DataFrame | None = None
    step, last = 0, -1
    while step < shards or step - last <= shards:
        held = spark.sparkContext.broadcast(table)
        shard = step % shards
        counted = (dealt.where(F.col("shard") == shard).select("lang", F.col("text").cast("binary").alias("text"))
                   .mapInArrow(_lazy_scan(held, step, shards, longest), "lang string, length int, phrase string, count long"))
        added = counted.selectExpr(*names, "0L AS total", "0L AS seen", "CAST(NULL AS INT) AS reached", f"{step} AS since", "count AS more")
        known = added if state is None else state.selectExpr(*names, "total", "seen", "reached", "since", "0L AS more").union(added)
        merged = known.groupBy(*names).agg(F.sum("total").alias("total"), F.bit_or("seen").alias("seen"), F.min("reached").alias("reached"),
                                           F.min("since").alias("since"), F.sum("more").alias("more"))
        fresh = F.col("seen").bitwiseAND(F.lit(1 << shard)) == 0
        merged = (merged.withColumn("total", F.col("total") + F.when(fresh, F.col("more")).otherwise(0))
                  .withColumn("seen", F.when(F.col("more") > 0, F.col("seen").bitwiseOR(F.lit(1 << shard))).otherwise(F.col("seen")))
                  .withColumn("reached", F.coalesce("reached", F.when((F.col("length") > 0) & (F.col("total") >= least), F.lit(step)))))
        # below the threshold after a full cycle: complete and dropped
        kept = merged.where((F.col("length") == 0) | F.col("reached").isNotNull() | (F.col("since") + shards - 1 > step))
        before, state = state, staged(kept.drop("more"), "phrases-state")
        if before is not None:
            unstaged(before)
        new = state.where((F.col("reached") == step) & (F.col("length") < longest))
        # at most slots / 64 rows come to the driver
        rows = new.select(*names).mapInArrow(_new_slots(slots), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        held.unpersist()
        if len(rows):
            last = step
            bits = np.unpackbits(rows["bits"].to_numpy(dtype=np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            table = table.copy()
            table[(rows["word"].to_numpy()[:, None] * 64 + np.arange(64))[bits]] = step + 1
        step += 1
    unstaged(dealt)
    return state.where((F.col("length") == 0) | (F.col("total") >= least)).select(*names, "total")


def _lazy_scan(held, step: int, shards: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scan(held.value, step, shards, longest)(batches)
    return run


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, lang_col: str = "lang", text_col: str = "text",
                 shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by their weakest cut."""
    counts = frequent_phrases(docs, least, longest, lang_col, text_col, shards, slots)
    counts = staged(counts, "phrases-frequent")
    known = counts.where("length > 0").select("lang", "phrase", "total")
    totals = counts.where("length = 0").select("lang", F.col("total").alias("n"))
    phrases = counts.where("length > 1").select("lang", "phrase", F.col("total").alias("a"), F.split("phrase", " ").alias("words"))

    def part(start, length):
        return F.concat_ws(" ", F.slice("words", start, length))

    cut = F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(
        k.alias("k"), part(F.lit(1), k).alias("left"), part(k + 1, F.size("words") - k).alias("right")))).alias("cut")
    cuts = staged(phrases.select("lang", "phrase", "a", cut).select("lang", "phrase", "a", "cut.*"), "phrases-cuts")
    lefts, rights = known.toDF("lang", "left", "l"), known.toDF("lang", "right", "r")
    wide = "decimal(19,0)"
    measured = (staged(cuts.join(lefts, ["lang", "left"]), "phrases-left").join(rights, ["lang", "right"]).join(totals, "lang")
                .withColumn("score", F.expr(f"CAST((CAST(a AS {wide}) * CAST(n AS {wide}) * 1000BD) DIV (CAST(l AS {wide}) * CAST(r AS {wide})) AS LONG)")))
    weakest = measured.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("weakest")).select("lang", "phrase", "a", "n", "weakest.*")
    # (start, length) of the proper parts of two words or more
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda at: part(at, k))))
    inner = (phrases.where(F.size("words") > 2).select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("longer"))
             .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    scored = staged(weakest, "phrases-scored").join(inner, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
