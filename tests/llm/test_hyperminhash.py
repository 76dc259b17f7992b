"""HyperMinHash groups against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from tests.llm.test_simhash import groups
from tidepool.llm import hyperminhash as H


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + 3]) for i in range(len(words) - 2)) or (frozenset([tuple(words)]) if words else frozenset())


def brute(rows, percent=85):
    """{row number: smallest identifier reachable} of (identifier, text) rows."""
    sets = [brute_set(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    top = groups(range(len(rows)), edges)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top[i]] = min(doc, least.get(top[i], doc))
    return [least.get(top[i]) for i in range(len(rows))], [len(s) for s in sets]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


def copies(seed=0):
    """Texts with copies at all distances from their base, of several lengths; one large group."""
    rng = random.Random(seed)
    rows = []
    for base, (n, group) in enumerate([(8, 6), (30, 12), (120, 250), (400, 15), (1200, 8), (1195, 4)]):
        words = [f"w{base}-{rng.randrange(10**6)}" for _ in range(n)]
        rows += [edited(rng, words, rng.randrange(0, max(2, n // 15))) for _ in range(group)]
        rows += [" ".join(words[:k]) for k in range(n, n - max(2, n // 6), -max(1, n // 40))]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, H.near_duplicate_sets(docs, **more).collect()), key=str)


def expected(rows):
    found, sizes = brute(rows)
    return sorted(((doc, n, c, doc == c) for (doc, _), c, n in zip(rows, found, sizes)), key=str)


def test_groups_equal_all_pairs(spark):
    rows = copies()
    assert run(spark, rows) == expected(rows)


def test_bands_cut_into_parts_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(H, "PART_MEMBERS", 40)
    monkeypatch.setattr(H, "PART_SHINGLES", 4_000)
    rows = copies(1)
    assert run(spark, rows) == expected(rows)


def test_nulls_empty_short_and_repeated_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two "), (7, "one two"), (8, "a b c"), (9, "A b\x0bc"),
            (None, "one two"), (None, "alone here now"), (None, None), (10, long), (11, long + " y"), (12, "É b c"), (13, "é b c")]
    assert run(spark, rows) == expected(rows)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, sid long, band long")
    assert H.near_duplicate_sets(docs).collect() == []
    docs = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "a b c d", 7, 8)], "doc_id long, text string, sid long, component long")
    assert sorted(map(tuple, H.near_duplicate_sets(docs).collect())) == [(1, 2, 1, True), (2, 2, 1, False)]


@pytest.mark.parametrize("n", [6, 40, 300, 1024, 5000])
def test_estimates_are_near_the_truth(n):
    rng = np.random.default_rng(n)
    errors = []
    for k in range(20):
        both = rng.integers(0, 2**63, n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, max(1, n // 12), dtype=np.uint64)])) for _ in range(2))
        c = H.size_class(len(a))
        truth = len(both) / (len(a) + len(b) - len(both))
        errors.append(H.estimates(H.sketch(a, c), H.sketch(b, c), np.array(len(a)), np.array(len(b))) - truth)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_registers_hold_zeros_and_mantissa():
    a = np.array([7], dtype=np.uint64)
    x = int(H.mix(a ^ H.mix(np.arange(1, 2, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)))[0])
    bits = format(x, "064b")
    rest = bits[8:]
    zeros = len(rest) - len(rest.lstrip("0"))
    want = ((zeros + 1) << 10) | int((rest[zeros + 1:] + "0" * 20)[:10], 2)
    got = H.sketch(a, 0)
    assert got[int(bits[:8], 2)] == want and np.count_nonzero(got) == 1


def test_close_sizes_share_a_class():
    for n in range(6, 6000):
        top = n * 100 // 85  # the largest size that a set of n can be linked with
        own = {H.size_class(n)} | ({H.size_class(n) - 1} if H.size_class(n) and H.size_class(n * 100 // 85 + 1) < H.size_class(n) else set())
        assert H.size_class(top) in own
