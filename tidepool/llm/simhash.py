"""SimHash near-duplicates by a forest of vantage-point trees over fingerprints.

A text's fingerprint has 64 bits, one for each bit position that is set in over
half of the hashes of its word shingles.  Two texts are linked when their
fingerprints differ in at most ``max_bits`` bits.

Fingerprints that close agree in all but ``max_bits // trees`` bits on at least
one of ``trees`` disjoint bit blocks (else the differences would add up to more).
So one vantage-point tree stands on each block, under the Hamming distance d of
that block and with the small search radius r = max_bits // trees:

* a node holds a vantage point v and a distance mu.  Points with d <= mu go to
  the near child, the others to the far child;
* the triangle inequality bounds |d(a, v) - d(b, v)| by d(a, b), so a near point
  with d <= mu - r cannot match a far one.  Those in mu - r < d <= mu overlap the
  boundary: they are also sent to the far child, as queries.

Every pair within the radius meets in a leaf of some tree, and there the full
distance over all 64 bits is tested.  Vantage points of the upper levels come
from a bounded sample (``SAMPLE`` fingerprints); all distinct fingerprints are
routed through them into shards by Spark, and each shard goes on splitting in
its task.  Where a block no longer separates points (all equal on it), the
splitting goes on under the full distance with radius ``max_bits``.  A shard that
is still too large is cut into parts, and each pair of parts is a task.

Leaves return stars (point, smallest linked point), never all their pairs; the
components of the stars' union are those of all links.

Defined cases: null and empty texts, or texts of white space only, have
fingerprint zero and are linked like others; rows repeat in the result as in the
input; a null identifier takes part, and a group's component is its smallest
non-null identifier (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import staged
from .components import connected_components

#: Fingerprints whose distances place the upper vantage points and radii, at most.
SAMPLE = 40_000
#: Points that a shard should hold, and beyond which it is cut into parts.
SHARD_POINTS, SHARD_LIMIT = 3_000, 12_000
#: Points whose pairs are compared directly.
LEAF = 192
#: Points of a node that its vantage point and radius are fitted to, at most.
PROBE = 4_096
SEED = 42

#: Shingles hashed at once, and bytes beyond which one is hashed alone.
HASH_BLOCK, HASH_BYTES = 1 << 14, 256
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def slice_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 (seed ``SEED``) of the slices raw[start:end], of at most ``HASH_BYTES`` bytes each."""
    padded = raw + bytes(8)
    octets = np.frombuffer(padded, dtype=np.uint8)
    lanes = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    seed, size = np.uint64(SEED), (ends - starts).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = size + (seed + _P5)
        wide = np.flatnonzero(size >= 32)
        wide = wide[np.argsort(size[wide])[::-1]]
        if len(wide):
            at, stripes = starts[wide], size[wide] >> np.uint64(5)
            sums = [np.full(len(wide), x) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            for k in range(int(stripes[0])):
                n = np.count_nonzero(stripes > k)
                for j, v in enumerate(sums):
                    v[:n] = _turn(v[:n] + lanes[at[:n] + (32 * k + 8 * j)] * _P2, 31) * _P1
            whole = _turn(sums[0], 1) + _turn(sums[1], 7) + _turn(sums[2], 12) + _turn(sums[3], 18)
            for v in sums:
                whole = (whole ^ (_turn(v * _P2, 31) * _P1)) * _P1 + _P4
            h[wide] = whole + size[wide]
        rest = (size & np.uint64(31)).astype(np.int64)
        at = ends - rest
        for k in range(3):
            own = np.flatnonzero(rest >= 8 * k + 8)
            h[own] = _turn(h[own] ^ (_turn(lanes[at[own] + 8 * k] * _P2, 31) * _P1), 27) * _P1 + _P4
        own = np.flatnonzero(rest & 4)
        h[own] = _turn(h[own] ^ ((lanes[at[own] + (rest[own] & 24)] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        for k in (3, 2, 1):
            own = np.flatnonzero((rest & 3) >= k)
            h[own] = _turn(h[own] ^ (octets[ends[own] - k] * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def _bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many hashes of each text have each bit; the texts' hashes lie one after another, at least one each."""
    runs = -(-sizes // 255)  # so many hashes add up in a byte
    first, first_run = np.cumsum(sizes) - sizes, np.cumsum(runs) - runs
    at = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    counts = np.empty((len(sizes), 8, 8), dtype=np.int64)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), at).astype("<u8")
        counts[:, :, k] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
    return counts.reshape(-1, 64)


def fingerprints(raws: Iterable[bytes | None], shingle_words: int = 4) -> np.ndarray:
    """The SimHashes of UTF-8 texts; A-Z are lower-cased, words lie between ASCII white space."""
    import xxhash

    texts = [(raw or b"").translate(_CLEAN).strip(b" ") for raw in raws]
    texts = [b" ".join(t.split()) if b"  " in t else t for t in texts]
    found = np.zeros(len(texts), dtype=np.uint64)
    filled = np.flatnonzero([len(t) > 0 for t in texts])
    if not len(filled):
        return found
    n_words = np.array([texts[t].count(b" ") + 1 for t in filled])
    joined = b" ".join(texts[t] for t in filled)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    sizes = np.maximum(n_words - shingle_words + 1, 1)
    of, past = np.repeat(np.arange(len(filled)), sizes), np.cumsum(n_words)
    first = np.arange(len(of)) + np.repeat(past - n_words - (np.cumsum(sizes) - sizes), sizes)  # a shingle's first word
    starts, ends = starts[first], ends[np.minimum(first + shingle_words, past[of]) - 1]
    hashes = np.empty(len(of), dtype=np.uint64)
    for at in range(0, len(of), HASH_BLOCK):
        s, e = starts[at:at + HASH_BLOCK], ends[at:at + HASH_BLOCK]
        short = e - s <= HASH_BYTES
        hashes[at:at + HASH_BLOCK][short] = slice_hashes(joined[s[0]:e[-1]], s[short] - s[0], e[short] - s[0])
        for k in np.flatnonzero(~short).tolist():
            hashes[at + k] = xxhash.xxh64_intdigest(joined[s[k]:e[k]], SEED)
    bits = 2 * _bit_counts(hashes, sizes) > sizes[:, None]
    found[filled] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return found


def fingerprint(raw: bytes | None, shingle_words: int = 4) -> int:
    """The SimHash of one text."""
    return int(fingerprints([raw], shingle_words)[0])


def fingerprint_column(text: Column, shingle_words: int = 4) -> Column:
    """The fingerprint as a signed long (the same 64 bits)."""

    @F.pandas_udf("long")
    def made(raws: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(raws, shingle_words).view(np.int64))

    return made(text.cast("binary"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- vantage-point trees ---------------------------------------------------

def block_masks(trees: int) -> list[np.uint64]:
    """Disjoint masks that cover 64 bits as evenly as possible."""
    cuts = [round(64 * k / trees) for k in range(trees + 1)]
    return [np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(cuts, cuts[1:])]


def _distance(points: np.ndarray, vantage, mask) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & mask)


def best_split(points: np.ndarray, mask, radius: int, tries: int = 4):
    """(vantage, mu, rows of the larger child) of the most even split found, or None.

    The radius is fitted to the first ``PROBE`` points (points come shuffled).
    """
    best = None
    points = points[:PROBE]
    n = len(points)
    for k in range(tries):
        vantage = points[(k * n) // tries]
        upto = np.cumsum(np.bincount(_distance(points, vantage, mask), minlength=65))
        below = np.concatenate([np.zeros(radius, dtype=upto.dtype), upto[:-radius]]) if radius else upto
        larger = np.maximum(upto, n - below)  # near child; far child with the overlap
        mu = int(np.argmin(larger))
        if best is None or larger[mu] < best[2]:
            best = (vantage, mu, int(larger[mu]))
    return best if best[2] <= 0.9 * n else None


def build_tree(sample: np.ndarray, mask, radius: int, depth: int, least: int = 24):
    """Nested (vantage, mu, near, far); None is a shard."""
    split = best_split(sample, mask, radius) if depth and len(sample) >= least else None
    if split is None:
        return None
    vantage, mu, _ = split
    d = _distance(sample, vantage, mask)
    return (vantage, mu, build_tree(sample[d <= mu], mask, radius, depth - 1, least), build_tree(sample[d > mu - radius], mask, radius, depth - 1, least))


def route(points: np.ndarray, tree, mask, radius: int, path: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, points), with points that overlap a boundary on both sides of it."""
    if not len(points):
        return
    if tree is None:
        yield path, points
        return
    vantage, mu, near, far = tree
    d = _distance(points, vantage, mask)
    yield from route(points[d <= mu], near, mask, radius, 2 * path)
    yield from route(points[d > mu - radius], far, mask, radius, 2 * path + 1)


def leaf_links(points: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (point, smallest of its component) of the links among ``points``."""
    n = len(points)
    if n < 2:
        return points[:0], points[:0]
    label = np.arange(n)
    block = max(1, 4_000_000 // n)
    while True:
        new = label
        for at in range(0, n, block):
            near = np.bitwise_count(points[at:at + block, None] ^ points[None, :]) <= max_bits
            low = np.where(near, label[None, :], n).min(axis=1)
            new = new.copy() if new is label else new
            new[at:at + block] = np.minimum(new[at:at + block], low)
        new = new[new]  # go on from where the neighbour has got to
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return points[moved], points[label[moved]]


def shard_links(points: np.ndarray, mask, radius: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stars of all leaves of the tree over one shard's points."""
    todo = [(points, mask, radius)]
    while todo:
        here, by, r = todo.pop()
        if len(here) <= LEAF:
            yield leaf_links(here, max_bits)
            continue
        split = best_split(here, by, r)
        d = split and _distance(here, split[0], by)
        children = [here[d <= split[1]], here[d > split[1] - r]] if split else [here]
        if max(map(len, children)) < len(here):
            todo += [(child, by, r) for child in children]
        elif r < max_bits:  # the block tells these points apart no more
            todo.append((here, np.uint64(0xFFFF_FFFF_FFFF_FFFF), max_bits))
        else:
            yield leaf_links(here, max_bits)


def fingerprint_links(fps: DataFrame, max_bits: int = 4, trees: int = 3) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``max_bits``.

    ``fps`` has distinct non-null longs in column ``fp``.
    """
    n = fps.count()
    radius, masks = max_bits // trees, block_masks(trees)
    share = max(1, -(-n // SAMPLE))
    picked = fps.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(share)) == 0).limit(2 * SAMPLE).toPandas()["fp"]
    sample = np.sort(picked.to_numpy(dtype=np.int64)).view(np.uint64)
    np.random.default_rng(SEED).shuffle(sample)
    depth = max(0, int(np.ceil(np.log2(max(1, n / SHARD_POINTS)))))
    forest = [build_tree(sample, mask, radius, depth) for mask in masks]

    def routed(parts: dict[int, int]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                points = batch["fp"].to_numpy(dtype=np.int64).view(np.uint64)
                for t, (tree, mask) in enumerate(zip(forest, masks)):
                    for path, own in route(points, tree, mask, radius):
                        shard = path * trees + t
                        g = parts.get(shard, 1)
                        if g == 1:
                            yield pd.DataFrame({"shard": shard, "part": 0, "fp": own.view(np.int64)})
                            continue
                        home = ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % g
                        for other in range(g):
                            low, high = np.minimum(home, other), np.maximum(home, other)
                            yield pd.DataFrame({"shard": shard, "part": low * g + high, "fp": own.view(np.int64)})
        return run

    schema = "shard long, part long, fp long"
    sizes = fps.mapInPandas(routed({}), schema).groupBy("shard").count().where(F.col("count") > SHARD_LIMIT).collect()
    parts = {r["shard"]: -(-2 * r["count"] // SHARD_LIMIT) for r in sizes}

    def linked(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(group["fp"].to_numpy(dtype=np.int64)).view(np.uint64)
        np.random.default_rng(SEED).shuffle(points)
        stars = list(shard_links(points, masks[int(key[0]) % trees], radius, max_bits))
        a, b = (np.concatenate(x) if x else points[:0] for x in zip(*stars)) if stars else (points[:0], points[:0])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

    return fps.mapInPandas(routed(parts), schema).groupBy("shard", "part").applyInPandas(linked, "a long, b long")


def fingerprint_components(fps: DataFrame, max_bits: int = 4, trees: int = 3) -> DataFrame:
    """Rows (fp, component) of the fingerprints that have a link."""
    links = staged(fingerprint_links(fps, max_bits, trees), "simhash-links")
    found = connected_components(links, "a", "b")
    return found.select(F.col("node").alias("fp"), "component")


def _row_keys(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that name a row by its identifier and text."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("__key"), F.xxhash64(F.col(text_col), F.lit(1), F.col(id_col)).alias("__key2")]


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): a row's identifier, hashes and fingerprint; a fingerprint's group and its first row."""
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), *_row_keys(id_col, text_col), fingerprint_column(F.col(text_col), shingle_words).alias("fp")), "simhash-docs")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__key", "__key2")
    fps = staged(rows.groupBy("fp").agg(F.min(place).alias("first")), "simhash-fps")
    linked = staged(fps.join(fingerprint_components(fps.select("fp"), max_bits), "fp", "left")
                    .select("fp", "first", F.coalesce("component", "fp").alias("component")), "simhash-linked")
    least = staged(linked.groupBy("component").agg(F.min("first").alias("least")), "simhash-least")
    return rows, staged(linked.select("fp", "component").join(least, "component").select("fp", "component", "least"), "simhash-groups")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: its identifier, fingerprint (long ``fp``) and component_id."""
    rows, groups = _grouped(docs, id_col, text_col, shingle_words, max_bits)
    return rows.join(groups, "fp").select(F.col("doc_id").alias(id_col), "fp", F.col("least.doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """The first document of each near-duplicate group (smallest identifier, null last), once; columns unchanged."""
    rows, groups = _grouped(docs, id_col, text_col, shingle_words, max_bits)
    keepers = staged(groups.select("component", "least.__key", "least.__key2").distinct().select("__key", "__key2"), "simhash-keepers")
    kept = docs.withColumns(dict(zip(("__key", "__key2"), _row_keys(id_col, text_col)))).join(keepers, ["__key", "__key2"])
    if not rows.groupBy("__key", "__key2").count().where("count > 1").isEmpty():  # rows that repeat whole
        kept = kept.dropDuplicates(["__key", "__key2"])
    return kept.select(*docs.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """Per row: identifier, fingerprint (16 hex digits), component_id (smallest identifier reachable)."""
    found = simhash_groups(docs, id_col, text_col, shingle_words, max_bits)
    return found.select(id_col, hex_of(F.col("fp")).alias("fingerprint"), "component_id")
