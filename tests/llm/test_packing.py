"""Packing against a plain best fit that looks at every bin, and its constraints."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tidepool.llm import packing
from tidepool.llm.queries import tokenizer_path


def plain(rows, capacity):
    """{row: (bin, offset)}: tightest compatible bin; the one that got its room first on equal room."""
    bins, out, tick = [], {}, 0
    for row, size, source, cluster in sorted(rows, key=lambda r: (-r[1], r[0])):
        fitting = [b for b in bins if b["room"] >= size and source not in b["sources"] - {None} and cluster not in b["clusters"] - {None}]
        if fitting:
            best = min(fitting, key=lambda b: (b["room"], b["since"]))
        else:
            best = {"room": capacity, "sources": set(), "clusters": set(), "name": len(bins), "since": 0}
            bins.append(best)
        tick += 1
        out[row] = (best["name"], capacity - best["room"])
        best["room"] -= size
        best["since"] = tick
        best["sources"].add(source)
        best["clusters"].add(cluster)
    return out


def test_shard_as_plain_best_fit():
    rng = random.Random(8)
    for case in range(40):
        rows = [(k, rng.randint(1, 100), rng.choice([None, "hot", "hot", f"s{rng.randint(0, 9)}"]), rng.choice([None, f"c{rng.randint(0, 30)}"])) for k in range(rng.randint(0, 150))]
        frame = pd.DataFrame(rows, columns=["row", "length", "source", "cluster"])
        done = packing.pack_shard(frame, 100)
        assert dict(zip(done["row"], zip(done["bin"], done["bin_offset"]))) == plain(rows, 100), case


def docs(spark, n=500):
    rng = random.Random(2)
    rows = [(2**60 + k, rng.choice([0, 5, 30, 99, 100, 101, 350]), "hot" if k % 3 == 0 else f"s{k % 7}", k // 4 if k % 5 else None) for k in range(n)]
    rows += [(None, 40, None, None), (7, None, "hot", 1), (8, 20, "x", 3), (8, 20, "x", 3), (9, 100_000, "long", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, n_tokens int, source string, cluster long").withColumn("bin_id", F.lit("clash")).withColumn("row", F.lit(1))


def test_pieces_cover_documents_and_bins_keep_the_constraints(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 60)
    rows, df = docs(spark)
    out = packing.pack(df, capacity=100).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {r[0] for r in rows}
    sizes, of = {}, {}
    for i, n, source, cluster in rows:
        sizes[i] = sizes.get(i, 0) + (n or 0)
        of[i] = (source, cluster)
    bins = {}
    for i, pieces in by_doc.items():
        assert sum(p.n_tokens for p in pieces) == sizes[i]
        if i != 8:
            at = 0
            for p in sorted(pieces, key=lambda p: p.piece):
                assert p.start == at and p.n_tokens <= 100
                at += p.n_tokens
        for p in pieces:
            assert (p.bin_id is None) == (p.n_tokens == 0)
            if p.bin_id:
                bins.setdefault(p.bin_id, []).append((p.bin_offset, p.n_tokens, *of[i]))
    for held in bins.values():
        held.sort()
        at = 0
        for offset, n, *_ in held:
            assert offset == at
            at += n
        assert at <= 100
        for k in (2, 3):
            named = [h[k] for h in held if h[k] is not None]
            assert len(named) == len(set(named))
    assert packing.pack(df.limit(0)).count() == 0


def test_documents_are_packed_by_their_tokens(spark):
    rows = [(1, "hello world", "a"), (2, "hello world", "b"), (3, None, "a"), (4, "", "a"), (5, "word " * 9000, "c"), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = packing.pack_documents(df, tokenizer_path()).collect()
    held = {r.doc_id: r.bin_id for r in out if r.piece == 0}
    assert held[1] != held[2] and held[3] is None and held[4] is None and held[None] is not None  # equal texts are kept apart
    assert len([r for r in out if r.doc_id == 5]) == 3


def test_near_copies_are_kept_apart(spark):
    from tidepool.llm.simhash import fingerprint

    rng = random.Random(4)
    rows = []
    for k in range(30):
        words = [f"w{rng.randrange(10_000)}" for _ in range(300)]
        near = words[:299] + ["other"]
        a, b = " ".join(words), " ".join(near)
        if 0 < (fingerprint(a.encode()) ^ fingerprint(b.encode())).bit_count() <= 4:
            rows += [(2 * k, a, f"s{2 * k}"), (2 * k + 1, b, f"s{2 * k + 1}")]
    assert len(rows) >= 10
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bins = {r.doc_id: r.bin_id for r in packing.pack_documents(df, tokenizer_path()).collect()}
    assert all(bins[i] != bins[i + 1] for i, _, _ in rows[::2])
    pair = spark.createDataFrame(rows[:2], df.schema)
    alone = [len({r.bin_id for r in packing.pack_documents(pair, tokenizer_path(), near=near).collect()}) for near in (True, False)]
    assert alone == [2, 1]  # there is room for both in one bin
