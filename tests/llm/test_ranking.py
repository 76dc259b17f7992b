"""Ranked search against a plain scorer."""

import math
import random
import re
from collections import Counter

import numpy as np

from tidepool.llm import ranking as R


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    rows = []
    for item, text in items:
        scored = []
        for (doc, c), size in zip(counts, sizes):
            m = 75 + (25 * size * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc))
        rows += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scored, key=str_last)[:k], 1)]
    return sorted(rows, key=str)


def str_last(row):
    score, null, doc = row
    return score, null, doc or 0


def run(spark, docs, items, **more):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, R.ranked(docs, items, **more).collect()), key=str)


def corpus(seed=0, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本", "a_b", "x-y"]
    text = lambda size: " ".join(rng.choices(vocabulary, k=size))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(n)]
    return docs, [(i, text(rng.randrange(1, 12))) for i in range(25)]


def test_equals_a_plain_scorer(spark):
    docs, items = corpus()
    assert run(spark, docs, items) == brute(docs, items)


def test_small_tiles_and_blocks_change_nothing(spark, monkeypatch):
    docs, items = corpus(1, 150)
    want = brute(docs, items, 5)
    monkeypatch.setattr(R, "TILE_TERMS", 7)
    monkeypatch.setattr(R, "TILE_DOCS", 11)
    monkeypatch.setattr(R, "BLOCK_ITEMS", 13)
    assert run(spark, docs, items, k=5) == want


def test_ties_nulls_empty_and_repeated_rows(spark):
    docs = [(5, "same words here"), (3, "same words here"), (3, "same words here"), (None, "same words here"), (9, None), (8, ""), (7, "..."), (1, "other")]
    items = [(1, "Same WORDS same"), (1, "Same WORDS same"), (2, None), (3, ""), (4, "absent"), (None, "other")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, k=2) == brute(docs, items, 2)


def test_long_texts_and_many_repeats(spark):
    docs = [(1, "red " * 400_000 + "blue"), (2, "red blue"), (3, "blue " * 50)]
    items = [(1, "red " * 3_000 + "blue")]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = corpus(2, 10)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    wide = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, id long, n long, score long")
    asked = spark.createDataFrame([(d, t, 1) for d, t in items], "item_id long, text string, rank long")
    assert sorted(map(tuple, R.ranked(wide, asked).collect()), key=str) == brute(docs, items)


def test_partial_sums_stay_below_the_bound(monkeypatch):
    monkeypatch.setattr(R, "EXACT", 100_000_000)
    block = R.Block([1, 2], ["a b c " * 40, "b " * 90])
    weights = [1, 2, 1]
    got = np.zeros((2, 3), dtype=np.int64)
    for own, q in block.tiles(weights):
        assert (q.sum(axis=1) * 2_000_001 < 100_000_000).all()
        np.add.at(got, (slice(None), own), q.astype(np.int64))
    assert got.tolist() == [[40, 40, 40], [0, 90, 0]]


def test_best_keeps_ties_by_identifier():
    scores, ids = np.array([5, 9, 5, 5, 0, 9]), np.array([4, 8, 2, 3, 1, 7])
    assert ids[R.best(scores, ids, 4)].tolist() == [7, 8, 2, 3]
