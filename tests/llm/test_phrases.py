"""Phrase mining against plain counting of everything."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidepool.llm import phrases as P


def brute_counts(docs, longest=5):
    totals, counts = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i:i + k])] += 1
    return totals, counts


def brute(docs, least, top=2000, longest=5):
    totals, counts = brute_counts(docs, longest)
    rows = []
    for lang, own in counts.items():
        candidates = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        best = {p: 0 for p in candidates}
        for p, c in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    best[p[i:i + k]] = max(best[p[i:i + k]], c)
        scored = []
        for p, a in candidates.items():
            if best[p] >= a:
                continue
            score, k = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        rows += [(lang, rank, p.decode(), -a, l, r, totals[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(rows)


def corpus(seed=0, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["École", "Z-z", "日本"]
    passage = "one Fixed passage of some words"
    docs = []
    for _ in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randrange(60)))
        docs.append((rng.choice(["en", "de", None]), text + (passage if rng.random() < 0.3 else "")))
    return docs


def run(spark, docs, **more):
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    return sorted(map(tuple, P.collocations(frame, **more).collect()))


@pytest.mark.parametrize(("shards", "slots"), [(3, 1 << 16), (4, 64), (2, 8)])  # few slots: nearly every test is a chance hit
def test_equals_plain_counting(spark, shards, slots):
    docs = corpus()
    assert run(spark, docs, least=12, shards=shards, slots=slots) == brute(docs, 12)


def test_counts_are_exact_for_every_frequent_phrase(spark):
    docs = corpus(3, 200)
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    got = {(r["lang"], r["phrase"]): r["total"] for r in P.frequent_phrases(frame, least=5, shards=5, slots=512).collect() if r["length"]}
    _, counts = brute_counts(docs)
    assert got == {(lang, " ".join(p)): c for lang, own in counts.items() for p, c in own.items() if c >= 5}


def test_nulls_empty_ties_and_limits(spark):
    docs = [("en", "a a a a a a"), (None, "a b. a b! A B"), ("und", "a b"), ("en", None), ("en", ""), ("fr", " \t\n"), ("de", "x y z x y z x y z")]
    for top in (1, 2000):
        assert run(spark, docs, least=2, top=top) == brute(docs, 2, top)


def test_long_text_clashing_columns_and_empty_table(spark):
    docs = [("en", "red blue green " * 120_000), ("en", "red blue")]
    frame = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "lang string, text string, phrase int, total int")
    assert sorted(map(tuple, P.collocations(frame, least=100).collect())) == brute(docs, 100)
    assert P.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_scores_past_64_bits_are_exact(spark):
    a, n, left, right = 3_000_000_019, 9_000_000_000_000_000_007, 4_000_000_007, 7_000_000_000_003
    row = spark.range(1).selectExpr(
        f"CAST((CAST({a}L AS decimal(19,0)) * CAST({n}L AS decimal(19,0)) * 1000BD) DIV (CAST({left}L AS decimal(19,0)) * CAST({right}L AS decimal(19,0))) AS LONG) AS s").first()
    assert row["s"] == 1000 * a * n // (left * right)


def test_hash_of_a_phrase_is_the_same_in_scan_and_table():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array(["one two three", "x"]), pa.array([3, 1], pa.int32())], ["lang", "phrase", "length"])
    (made,) = P._new_slots(1 << 20)(iter([batch]))
    table = np.zeros(1 << 20, dtype=np.uint8)
    bits = np.unpackbits(made["bits"].to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    table[(made["word"].to_numpy()[:, None] * 64 + np.arange(64))[bits]] = 1
    assert 2 <= int(table.sum()) <= 4
    # with both slots of the three-word phrase set and its subphrases unknown, nothing longer is emitted
    text = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([b"zero one two three"], pa.binary())], ["lang", "text"])
    assert [r for b in P._scan(table, 5, 3, 5)(iter([text])) for r in b.to_pylist()] == []
