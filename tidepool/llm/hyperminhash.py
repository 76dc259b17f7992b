"""HyperMinHash near-duplicates: texts whose sets of word shingles have a Jaccard similarity of a threshold or more.

Sketch.  A shingle's hash names one of ``BUCKETS`` buckets by its first bits; of the
rest only the smallest of each bucket counts, and of that only the number of leading
zeros and the ``MANTISSA`` bits behind the first one are stored: 16 bits a bucket.
A small set would leave buckets empty, so sets are put into size classes, and a class
inserts each shingle under that many independent hashes that a bucket gets about 8 or
more.  Sizes of linked sets differ by the threshold's factor at most; a set that close
below a class is sketched in both, so linked sets always meet in one class.

Bands.  ``ROWS`` neighbouring registers are a band; two sets with Jaccard J agree on a
band with probability J**7, and on none of 36 with 9e-7 at J = 0.85.  Sets that agree
on a band are candidates.

Estimate.  J is estimated as (equal registers - expected chance collisions) / (registers
used by either); candidates over five standard deviations below the threshold (3e-6 of
pairs at the threshold itself) are dropped, the rest are verified on the full sets.

Links.  Equal sets are one node from the start.  Then each set is verified with the
best of its bands' centres (the member with the largest bands), which joins most of a
group of copies at a pair per set.  Bands whose members are then still in several
components are compared in blocks: tasks hold two parts of a band, compare sketches
across components, verify on the full sets and return only the links that join
components.  No pair is left out, and no group is held whole by a task.

Sets are held as 64-bit hashes of their shingles, and a set is named by 64 bits of a
digest of all; 128 bits tell sets apart while they are grouped.

Defined cases: null texts and texts without words have an empty set, are linked with
nothing and are their own component.  Of fewer words than a shingle the whole sequence
is the one shingle.  Rows repeat in the result as in the input.  A null identifier
takes part; a component's name is its smallest non-null identifier (null if none).
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepool.operators.bloom import bloom_of, might_hold, words_for

from .common import staged
from .components import connected_components
from .words import byte_table, mix, words

BUCKETS, MANTISSA = 256, 10
#: Registers of a band, and bands (the last few registers are in none).
ROWS, BANDS = 7, 36
#: Shingle insertions a sketch should have at least.
INSERTIONS = 2048
#: Standard deviations below the threshold at which an estimate is dropped.
DEVIATIONS = 5
#: Bytes of text whose words are hashed at once.
TEXT_BLOCK = 1 << 19
#: Band members whose sketches, and shingles whose sets, are one part of a band.
PART_MEMBERS, PART_SHINGLES = 1_024, 1_000_000
#: The constant of the expected number of chance collisions (Yu and Weber, HyperMinHash, 2019).
COLLISIONS = 0.169919487159739093975315012348630288

_WHITE = b" \t\n\x0b\x0c\r"
_TABLE = byte_table(c for c in range(256) if c not in _WHITE)


def shingle_sets(texts, shingle_words: int = 3) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order (empty without words)."""
    texts = list(texts)
    held: list[np.ndarray] = []
    at = 0

    def made(parts: list[np.ndarray]) -> np.ndarray:
        h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        if not len(h):
            return h
        k = min(shingle_words, len(h))
        n = len(h) - k + 1
        found = np.full(n, k if len(h) < shingle_words else 0, dtype=np.uint64)
        for i in range(k):
            found = mix(found * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
        return np.unique(found)

    for block in words(texts, _TABLE, block=TEXT_BLOCK):
        if not len(block):
            continue
        cuts = np.flatnonzero(np.diff(block.text)) + 1
        for i, part in zip(block.text[np.concatenate([[0], cuts])].tolist(), np.split(block.hash, cuts)):
            while at < i:
                yield made(held)
                held, at = [], at + 1
            held.append(part)
    while at < len(texts):
        yield made(held)
        held, at = [], at + 1


def size_class(n: int) -> int:
    """The class of a set of n shingles; class c inserts each under 4**c hashes."""
    c = 0
    while n * 4 ** c < INSERTIONS:
        c += 1
    return c


def sketch(shingles: np.ndarray, size: int) -> np.ndarray:
    """The registers (0: empty) of a set in a size class."""
    rounds = mix(np.arange(1, 4 ** size + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    # rounds of a large set are taken a few at a time, so that memory stays near the set's own size
    step = max(1, (1 << 18) // max(1, len(shingles)))
    low = np.full(BUCKETS, 0xFFFF_FFFF_FFFF_FFFF, dtype=np.uint64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    heads = np.arange(BUCKETS, dtype=np.uint64) << shift
    for at in range(0, len(rounds), step):
        x = np.sort(mix(shingles[None, :] ^ rounds[at:at + step, None]), axis=None)
        first = np.searchsorted(x, heads)
        inside = first < len(x)
        inside[inside] = (x[first[inside]] >> shift) == np.flatnonzero(inside).astype(np.uint64)
        low[inside] = np.minimum(low[inside], x[first[inside]])
    rest = low << np.uint64(64 - int(shift))
    top = rest >> np.uint64(11)  # 53 bits: exact as a double, so its exponent is exact
    zeros = 53 - np.frexp(top.astype(np.float64))[1]
    zeros = np.where(top == 0, 53, zeros).astype(np.uint64)
    kept = (rest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    registers = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | kept
    return np.where(low == 0xFFFF_FFFF_FFFF_FFFF, 0, registers).astype("<u2")


def estimates(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of sketches, over the last axis."""
    return _corrected(((a == b) & (a != 0)).sum(axis=-1), ((a != 0) | (b != 0)).sum(axis=-1), size_a, size_b)


def _corrected(equal: np.ndarray, used: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The estimate from the numbers of equal and of used registers."""
    product = size_a.astype(float) * size_b
    chance = COLLISIONS * BUCKETS / 2 ** MANTISSA * 4 * product / (size_a.astype(float) + size_b) ** 2
    return (equal - chance) / np.maximum(used, 1)


def _packed(flags: np.ndarray) -> np.ndarray:
    """Rows of BUCKETS flags as 64-bit words."""
    return np.packbits(flags, axis=1).view(np.uint64)


def least_estimate(threshold: float) -> float:
    return threshold - DEVIATIONS * (threshold * (1 - threshold) / BUCKETS) ** 0.5


def _band_keys(registers: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit key for each band, telling classes and bands apart."""
    bands = registers[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(len(bands), dtype=np.uint64) * np.uint64(64) + np.uint64(size)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, i] + np.uint64(1))
    return key


def _names(shingles: np.ndarray) -> tuple[int, int]:
    import xxhash

    digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes()), dtype="<i8")
    return int(digest[0]), int(digest[1])


def _sketched(shingle_words: int, percent: int):
    """Arrow batches (…, text) to (…, n, sid, sid2, sketches)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            sizes, sids, others, sketches = [], [], [], []
            for s in shingle_sets(batch.column(at).to_pylist(), shingle_words):
                n = len(s)
                own = []
                # a set this small is linked with equal sets only
                if n and n * (100 - percent) >= percent:
                    c = size_class(n)
                    own = [{"size": c, "registers": sketch(s, c).tobytes()}]
                    if c and size_class(n * 100 // percent + 1) < c:
                        own.append({"size": c - 1, "registers": sketch(s, c - 1).tobytes()})
                sid, other = _names(s) if n else (None, None)
                sizes.append(n), sids.append(sid), others.append(other), sketches.append(own)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [f.name for f in batch.schema if f.name != "text"]
            made = [pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(others, pa.int64()),
                    pa.array(sketches, pa.list_(pa.struct([("size", pa.int32()), ("registers", pa.binary())])))]
            yield pa.RecordBatch.from_arrays(columns + made, names + ["n", "sid", "sid2", "sketches"])
    return run


def _in_parts(members: DataFrame, weight: str, limit: int) -> DataFrame:
    """Members of bands, once for each pair of parts that their own part is in.

    A band is cut into as many parts as its weight asks for; ``part`` numbers the
    pair of parts and ``home`` the member's own.
    """
    totals = members.groupBy("band").agg(F.ceil(F.sum(weight) / limit).cast("int").alias("parts"))
    dealt = members.join(totals, "band").withColumn("home", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return (dealt.withColumn("other", other)
            .withColumn("part", F.least("home", "other") * F.col("parts") + F.greatest("home", "other")).drop("other"))


def _compared(group: pd.DataFrame, percent: int):
    """(members, their rows x and admissible partners) of one pair of parts of a band."""
    group = group.drop_duplicates("sid")
    registers = np.stack([np.frombuffer(r, dtype="<u2") for r in group["registers"]])
    n, comp, home = (group[c].to_numpy() for c in ("n", "component", "home"))
    band, two = int(group["number"].iloc[0]), int(group["parts"].iloc[0])
    low, high = divmod(int(group["part"].iloc[0]), two)
    least = least_estimate(percent / 100)
    names, counts = np.unique(comp, return_counts=True)
    largest = names[np.argmax(counts)]
    filled = _packed(registers != 0)

    def partners(x: int, label: np.ndarray) -> np.ndarray:
        apart = (label != label[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        apart &= (home == low + high - home[x]) if low != high else True
        # of two members outside the largest component, the first looks at the second
        apart &= (comp == largest) | (np.arange(len(n)) > x)
        if not apart.any():
            return np.empty(0, np.int64)
        equal = np.bitwise_count(_packed(registers == registers[x]) & filled).sum(axis=1)
        used = np.bitwise_count(filled | filled[x]).sum(axis=1)
        at = np.flatnonzero(apart & (_corrected(equal, used, n, n[x]) >= least))
        agree = (registers[at] == registers[x])[:, :BANDS * ROWS].reshape(len(at), BANDS, ROWS).all(axis=2)
        return at[agree.argmax(axis=1) == band]  # a pair belongs to its first common band

    return group, comp, np.flatnonzero(comp != largest), partners


def _open_members(percent: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group, comp, outside, partners = _compared(group, percent)
        hit = np.zeros(len(group), dtype=bool)
        for x in outside:
            found = partners(int(x), comp)
            if len(found):
                hit[found] = hit[x] = True
        return pd.DataFrame({"band": group["band"].to_numpy()[hit], "sid": group["sid"].to_numpy()[hit]})
    return run


def _verified_links(percent: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group, comp, outside, partners = _compared(group, percent)
        label, sids = np.unique(comp, return_inverse=True)[1], group["sid"].to_numpy()
        sets = [np.frombuffer(s, dtype="<u8") for s in group["shingles"]]
        links = []
        for x in outside:
            found = partners(int(x), label)
            while len(found):
                now, found = found[:64], found[64:]
                own = sets[x]
                theirs = np.concatenate([sets[y] for y in now])
                at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                sizes = np.array([len(sets[y]) for y in now])
                both = np.add.reduceat((own[at] == theirs).astype(np.int64), np.cumsum(sizes) - sizes)
                for y in now[100 * both >= percent * (sizes + len(own) - both)]:
                    if label[y] != label[x]:
                        links.append((sids[x], sids[y]))
                        label[label == label[y]] = label[x]
                found = found[label[found] != label[x]]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")
    return run


def set_links(docs: DataFrame, rows: DataFrame, sets: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Edges (a, b) between set names whose components are those of all links."""
    sketches = staged(sets.select("sid", "n", F.inline("sketches")).withColumnRenamed("size", "class"), "hmh-sketches")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_band_keys(np.frombuffer(r, dtype="<u2"), c) for r, c in zip(batch["registers"].to_pylist(), batch["class"].to_pylist())]
            if not keys:
                continue
            each = len(keys[0])
            at = pa.array(np.repeat(np.arange(len(keys)), each))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(np.arange(each, dtype=np.int32), len(keys))),
                 batch["sid"].take(at), batch["class"].take(at)], ["band", "number", "sid", "class"])

    bands = staged(sketches.select("sid", "class", "registers").mapInArrow(banded, "band long, number int, sid long, class int"), "hmh-bands")
    shared = staged(bands.groupBy("band").agg(F.count("*").alias("members"), F.min("sid").alias("lo"), F.max("sid").alias("hi"))
                    .where("lo < hi").select("band", "members"), "hmh-shared")
    members = staged(bands.join(shared, "band"), "hmh-members")

    # One pair for each set: the centre it resembles most.
    weight = staged(members.groupBy("sid").agg(F.sum("members").alias("weight")), "hmh-weight")
    centres = staged(members.join(weight, "sid").groupBy("band").agg(F.max(F.struct("weight", "sid")).alias("centre"))
                     .select("band", F.col("centre.sid").alias("centre")), "hmh-centres")
    tries = staged(members.join(centres, "band").where("sid <> centre").select("sid", "centre", "class").distinct(), "hmh-tries")
    own = sketches.select("sid", "class", "n", "registers")
    theirs = own.toDF("centre", "class", "n2", "registers2")
    least = least_estimate(percent / 100)

    @F.pandas_udf("double")
    def estimated(a: pd.Series, b: pd.Series, size_a: pd.Series, size_b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        x, y = (np.frombuffer(b"".join(s), dtype="<u2").reshape(-1, BUCKETS) for s in (a, b))
        return pd.Series(estimates(x, y, size_a.to_numpy(), size_b.to_numpy()))

    guessed = tries.join(own, ["sid", "class"]).join(theirs, ["centre", "class"]).select("sid", "centre", estimated("registers", "registers2", "n", "n2").alias("guess"))
    pairs = staged(guessed.where(F.col("guess") >= least).groupBy("sid").agg(F.max(F.struct("guess", "centre")).alias("best"))
                   .select("sid", F.col("best.centre").alias("centre")), "hmh-pairs")
    wanted = pairs.select("sid").union(pairs.select("centre"))
    full = _full_sets(docs, sets, wanted.distinct(), shingle_words, "hmh-star-sets")

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_linked(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8"), percent) for x, y in zip(a, b)], dtype=bool)

    stars = staged(pairs.join(full, "sid").join(full.toDF("centre", "shingles2"), "centre")
                   .where(verified("shingles", "shingles2")).select(F.col("sid").alias("a"), F.col("centre").alias("b")), "hmh-stars")

    # What the stars leave in several components is compared in blocks.
    found = staged(connected_components(stars, "a", "b"), "hmh-found")
    known = members.join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    known = staged(known.select("band", "number", "sid", "class", "component"), "hmh-known")
    split = staged(known.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band"), "hmh-split")
    split_members = staged(known.join(split, "band").join(own, ["sid", "class"]), "hmh-split-members")
    dealt = _in_parts(split_members.withColumn("one", F.lit(1)), "one", PART_MEMBERS)
    left = staged(dealt.groupBy("band", "part").applyInPandas(_open_members(percent), "band long, sid long").distinct(), "hmh-open")
    rest = _full_sets(docs, sets, left.select("sid").distinct(), shingle_words, "hmh-open-sets")
    carried = staged(split_members.join(left, ["band", "sid"]), "hmh-carried")
    dealt = _in_parts(carried, "n", PART_SHINGLES).join(rest, "sid")
    more = staged(dealt.groupBy("band", "part").applyInPandas(_verified_links(percent), "a long, b long"), "hmh-links")
    return stars.union(more)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _row_keys(id_col: str, text_col: str):
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.xxhash64(F.col(text_col), F.lit(1), F.col(id_col)).alias("key2")]


def _full_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, shingle_words: int, name: str) -> DataFrame:
    """(sid, shingles) of the wanted sets, each made again from the text of its first row."""
    places = staged(sets.join(wanted, "sid").select("sid", "first.key", "first.key2"), f"{name}-places")
    # a filter in the scan keeps the other rows' texts out of the join's shuffle
    size = words_for(places.count())
    near = might_hold(docs, bloom_of(places, ["key", "key2"], size), ["key", "key2"], size)
    texts = near.join(places, ["key", "key2"]).dropDuplicates(["key", "key2"]).select("sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [s.astype("<u8").tobytes() for s in shingle_sets(batch["text"].to_pylist(), shingle_words)]
            yield pa.RecordBatch.from_arrays([batch["sid"], pa.array(made, pa.binary())], ["sid", "shingles"])

    return staged(texts.mapInArrow(run, "sid long, shingles binary"), name)


def near_duplicate_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, percent: int = 85) -> DataFrame:
    """Per row: its identifier, n_shingles, component_id and kept (it names its component)."""
    own = docs.select(F.col(id_col).alias("id"), *_row_keys(id_col, text_col), F.col(text_col).cast("binary").alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, key long, key2 long, n long, sid long, sid2 long, sketches array<struct<size: int, registers: binary>>"
    rows = staged(own.mapInArrow(_sketched(shingle_words, percent), schema), "hmh-rows")
    first = F.struct(F.col("id").isNull().alias("unnamed"), "id", "key", "key2")
    sets = staged(rows.where("n > 0").groupBy("sid", "sid2", "n").agg(F.min(first).alias("first"), F.first("sketches").alias("sketches")), "hmh-sets")
    links = set_links(own, rows, sets, shingle_words, percent)
    found = staged(connected_components(links, "a", "b").withColumnRenamed("node", "sid"), "hmh-components")
    named = staged(sets.select("sid", "sid2", "first").join(found, "sid", "left").withColumn("component", F.coalesce("component", "sid")), "hmh-named")
    least = staged(named.groupBy("component").agg(F.min("first").alias("least")), "hmh-least")
    names = staged(named.join(least, "component").select("sid", "sid2", F.col("least.id").alias("component_id")), "hmh-names")
    full = rows.where("n > 0").join(names, ["sid", "sid2"]).select("id", "n", "component_id")
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.union(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                                    F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
