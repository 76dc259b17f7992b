"""Decontamination against a plain search for every window."""

import hashlib
import random
import re
import time

import pytest

from tidepool.llm import decontaminate as dc


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, width=10):
    words, hit, names = fold(text), set(), set()
    for name, item in items:
        own = fold(item)
        size = min(width, len(own))
        for a in range(len(own) - size + 1 if own else 0):
            for p in range(len(words) - size + 1):
                if words[p:p + size] == own[a:a + size]:
                    hit |= set(range(p, p + size))
                    if name is not None:
                        names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "É", "été", "x1", "9", "the", "of", "日本", "Zed"]
    sentence = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, sentence(rng.choice([3, 9, 10, 11, 30]))) for k in range(12)] + [(3, sentence(12)), (None, sentence(15)), (50, ""), (51, None), (52, "... !!"), (53, "Unique")]
    docs = []
    for k in range(60):
        own = [sentence(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            words = fold(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(words) - 3))
            own += [rng.choice([" ", "! ", "\n"]).join(words[a:a + rng.randint(5, 30)]).upper(), sentence(rng.randint(0, 5))]
        docs.append((k, ", ".join(own)))
    docs += [(100, None), (101, ""), (102, "?!"), (None, docs[1][1]), docs[2], docs[2], (103, "the " * 30_000 + "unique end")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_window(spark, seed, monkeypatch):
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    keyed = {}
    for i, t in docs:
        keyed[(i, t)] = brute(t, items) if len(t or "") < 10_000 else None
    for blocks in (False, True):
        if blocks:  # several blocks of the benchmark must give the same
            monkeypatch.setattr(dc, "BLOCK_BYTES", 600)
        out = dc.contamination(d, b).collect()
        assert len(out) == len(docs)
        want = sorted(((i, *keyed[(i, t)]) for i, t in docs if keyed[(i, t)]), key=repr)
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out if r.doc_id != 103), key=repr)
        assert got == want
        last = next(r for r in out if r.doc_id == 103)
        assert last.n_words == 30_002 and last.contaminated and "53" in {m.item_id for m in last.matches}
    kept = dc.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in d.collect() if keyed[(r.doc_id, r.text)] and not keyed[(r.doc_id, r.text)][4])


def test_longest_matches_and_their_places():
    test = dc.TestWindows([("a", " ".join(f"w{k}" for k in range(30)).encode())])
    text = "x y " + " ".join(f"w{k}" for k in range(5, 25)) + " z " + " ".join(f"w{k}" for k in range(12)) + " w14 w15"
    lengths, matches, items = dc.shard_matches([text.encode(), None, b"w1 w2"], test)
    assert lengths == [2 + 20 + 1 + 12 + 2, 0, 2] and matches[1:] == [[], []] and items == [["a"], [], []]
    assert sorted((m["doc_start"], m["item_start"], m["n_words"]) for m in matches[0]) == [(2, 5, 20), (23, 0, 12)]


def test_every_position_has_its_longest_match():
    rng = random.Random(7)
    word = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    for _ in range(60):
        items = [(str(k), word(rng.randint(1, 14)).encode()) for k in range(rng.randint(1, 6))]
        texts = [word(rng.randint(0, 40)) for _ in range(3)]
        _, matches, named = dc.shard_matches([t.encode() for t in texts], dc.TestWindows(items, 3))
        own = [(i, t.decode().split()) for i, t in items]
        for text, found, names in zip(texts, matches, named):
            words, want = text.split(), []
            assert sorted(names) == sorted(i for i, t in own if any(words[p:p + len(w)] == w for w in ([t[a:a + 3] for a in range(len(t) - 2)] or [t]) for p in range(len(words) - len(w) + 1)))
            for m in found:  # each is verbatim
                item = dict(own)[m["item_id"]]
                assert words[m["doc_start"]:m["doc_start"] + m["n_words"]] == item[m["item_start"]:m["item_start"] + m["n_words"]]
            for p in range(len(words)):
                longest = 0
                for _, t in own:
                    for a in range(len(t)):
                        n = 0
                        while p + n < len(words) and a + n < len(t) and words[p + n] == t[a + n]:
                            n += 1
                        longest = max(longest, n if len(t) >= 3 else 0)
                want.append(longest if longest >= 3 else 0)
            kept = {(p, n) for p, n in enumerate(want) if n and not (p and want[p - 1] == n + 1)}
            assert kept == {(m["doc_start"], m["n_words"]) for m in found if len(dict(own)[m["item_id"]]) >= 3}


def test_periodic_text_and_shared_passages_stay_linear():
    began = time.monotonic()
    test = dc.TestWindows([("p", b"ha " * 2_000)])
    lengths, matches, items = dc.shard_matches([b"ha " * 100_000], test)
    assert lengths == [100_000] and items == [["p"]]
    assert matches[0][0]["n_words"] == 2_000 and len(matches[0]) == 98_001
    passage = " ".join(f"s{k}" for k in range(20))
    test = dc.TestWindows([(str(k), f"own{k} {passage} more{k}".encode()) for k in range(2_000)])
    _, matches, items = dc.shard_matches([f"d{k} {passage} e{k}".encode() for k in range(500)], test)
    assert all(len(m) == 1 and m[0]["n_words"] == 20 for m in matches) and all(len(i) == 2_000 for i in items)
    assert time.monotonic() - began < 30  # seconds; pairs of places would take minutes


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "keep", 5)], "doc_id long, text string, matches string, n_words int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in dc.decontaminate(docs, none).collect()] == [(1, "a b c", "keep", 5)]
    assert dc.contamination(docs, none).first().n_words == 3
    some = spark.createDataFrame([(1, "B C")], "item_id long, text string")
    assert dc.decontaminate(docs, some).count() == 0 and dc.contamination(docs.limit(0), some).count() == 0
