"""SimHash groups against all pairs, on texts and on fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidepool.llm import simhash
from tidepool.llm.components import connected_components


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_of_a_batch():
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "Bc", "É", " ", "  ", "\n", "\t", "\x1c", "\x00", "word" * 3, "long" * 20]) for _ in range(rng.randint(0, 80))) for _ in range(600)]
    texts += ["", " ", "one", "one two three", "x" * 5000 + " b c d e", "p q " * 9000]
    for k in (1, 3, 4):
        found = simhash.fingerprints([None, *(t.encode() for t in texts)], k)
        assert found.tolist() == [0, *(brute_fingerprint(t, k) for t in texts)]
    raw = bytes(rng.randrange(256) for _ in range(2000))
    starts = np.array([rng.randrange(1700) for _ in range(3000)])
    ends = starts + np.array([rng.randrange(simhash.HASH_BYTES + 1) for _ in starts])
    assert simhash.slice_hashes(raw, starts, ends).tolist() == [xxhash.xxh64_intdigest(raw[s:e], simhash.SEED) for s, e in zip(starts, ends)]
    assert not len(simhash.fingerprints([]))


def groups(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute_links(points, bits):
    return [(int(points[i]), int(points[j])) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points[i] ^ points[i + 1:]) <= bits) + i + 1]


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 2**64, n, dtype=np.uint64)
    near = points[:n // 4].copy()
    ball = np.repeat(points[:1], n // 3)
    for group, most in ((near, 7), (ball, 4)):
        for i in range(len(group)):
            for bit in rng.integers(0, 64, rng.integers(1, most)):
                group[i] ^= np.uint64(1) << np.uint64(bit)
    return np.unique(np.concatenate([points, near, ball]))


@pytest.mark.parametrize("bits,trees", [(4, 3), (4, 1), (3, 2), (0, 2), (7, 3)])
def test_forest_finds_all_links(bits, trees):
    points = clustered(1500)
    radius, found = bits // trees, []
    for mask in simhash.block_masks(trees):
        tree = simhash.build_tree(points, mask, radius, 4)
        for _, own in simhash.route(points, tree, mask, radius):
            np.random.default_rng(1).shuffle(own)
            for a, b in simhash.shard_links(own, mask, radius, bits):
                found += zip(a.tolist(), b.tolist())
    assert all(int(a ^ b).bit_count() <= 64 for a, b in found)
    assert groups(points.tolist(), found) == groups(points.tolist(), brute_links(points, bits))


def test_distributed_links_with_cut_shards(spark, monkeypatch):
    points = clustered(900, 3)
    monkeypatch.setattr(simhash, "SHARD_POINTS", 60)
    monkeypatch.setattr(simhash, "SHARD_LIMIT", 100)
    monkeypatch.setattr(simhash, "LEAF", 16)
    fps = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").repartition(3)
    found = {r.fp: r.component for r in simhash.fingerprint_components(fps).collect()}
    signed = points.view(np.int64)
    want = groups(signed.tolist(), [(int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))) for a, b in brute_links(points, 4)])
    named = {}
    for fp in signed.tolist():
        named.setdefault(found.get(fp, fp), set()).add(fp)
    wanted = {}
    for fp, c in want.items():
        wanted.setdefault(c, set()).add(fp)
    assert sorted(map(sorted, named.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert len({found[i] for i in range(41)}) == 1 and len({found[i] for i in range(100, 160)}) == 1 and found[200] == 200
    assert len(set(found.values())) == 3 and set(found) == {*range(41), *range(100, 160), 200}
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def texts():
    rng = random.Random(4)
    base = [" ".join(rng.choice(["Alpha", "beta", "GAMMA", "delta", "é", "zeta", "eta\t", "x\x0by"]) + str(rng.randint(0, 60)) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    near = []
    for t in base[:30]:
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    return base + near + base[:5] + ["", "   ", "\n", "one", "one two three", "a " * 9000]


def rows():
    all_texts = texts()
    named = [(2**60 + k, t) for k, t in enumerate(all_texts)]
    return named + [(None, all_texts[0]), (None, None), (3, None), named[7], named[7], (None, "only unnamed words here"), (None, "only unnamed words here")]


def test_documents_against_all_pairs(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    fps = [brute_fingerprint(t) for _, t in data]
    points = np.unique(np.array(fps, dtype=np.uint64))
    top = groups(points.tolist(), brute_links(points, 4))
    least = {}
    for (i, _), fp in zip(data, fps):
        if i is not None:
            least[top[fp]] = min(least.get(top[fp], i), i)
    want = sorted(((i, f"{fp:016x}", least.get(top[fp])) for (i, _), fp in zip(data, fps)), key=repr)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == want
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    by_group = {}
    for r in kept.collect():
        by_group.setdefault(top[brute_fingerprint(r.text)], []).append(r.doc_id)
    assert {c: v for c, v in by_group.items()} == {c: [least.get(c)] for c in {top[fp] for fp in fps}}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one_of_each(empty).count() == 0
