"""Quality rules: counts against a plain version, learned lists on made-up labels."""

import random
import re
from collections import Counter

import numpy as np

from tidepool.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_of_random_texts():
    rng = random.Random(3)
    pieces = ["a", "b", "the", " ", " ", "\n", "\t", "#", "é", "😀", "|", "\x0b", "\x1c", "<x>", "line one\n", "a b c d e "]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 80)))
        assert rules.count_text(text.encode())[:5] == brute(text), repr(text)
    assert rules.count_text(None) == rules.count_text(b"") == (0,) * 7
    assert rules.count_text(("same words here again and " * 20_000).encode())[4] == 100_000


def made(n=600):
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(n):
        bad = k % 3 == 0
        words = [rng.choice(["tree", "river", "stone", "cloud"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(15, 60))]
        if bad:
            words = [w + "###" for w in words] if k % 2 else [w[:1] for w in words]
        docs.append((k, " ".join(words)))
        labels.append((k, 0 if bad else 1, 0))
    return docs, labels


def test_learned_list_on_held_out_documents(spark):
    docs, labels = made()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame([x for x in labels if x[0] < 400] + [(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    learned = rules.learn(d, l)
    assert 1 <= len(learned) <= rules.RULES
    out = {r.doc_id: r for r in rules.judge(d, learned).collect()}
    held = [k for k, _ in docs if k >= 400]
    right = sum(out[k].base_failed or out[k].kept == bool(labels[k][1]) for k in held)
    assert right / len(held) > 0.97
    assert all(out[k].kept for k in held if labels[k][1] and not out[k].base_failed)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "few words"), (5, "w " * 50), (6, " ".join(f"w{k}" for k in range(30))), (6, " ".join(f"w{k}" for k in range(30))), (None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as kept", "7 as other")
    out = rules.judge(d, []).collect()
    assert [(r.doc_id, r.n_words, r.base_failed, r.kept, r.other) for r in out] == [
        (1, 0, True, False, 7), (2, 0, True, False, 7), (3, 0, True, False, 7), (4, 2, True, False, 7), (5, 50, True, False, 7), (6, 30, False, True, 7),
        (6, 30, False, True, 7), (None, 1, True, False, 7)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.learn(d, none) == [] and rules.judge(d.limit(0), []).count() == 0
    one_kind = spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int")
    assert rules.learn(d, one_kind) == []


def test_conditions_are_ordered_columns(spark):
    learned = [[rules.Condition("symbols_a_word", True, 0.5)], [rules.Condition("word_length", False, 1.5), rules.Condition("words", True, 12.0)]]
    d = spark.createDataFrame([(1, "ab## " * 3 + " ".join(f"w{k}x" for k in range(9))), (2, " ".join("abcdefghijklmno")), (3, " ".join("abcdefghijk"))], "doc_id long, text string")
    assert [r.kept for r in rules.judge(d, learned).collect()] == [not (6 / 12 >= 0.5), False, True]


def test_growing_needs_a_gain():
    values = {"x": np.arange(90, dtype=float)}
    assert rules.learn_list(values, np.zeros(90, dtype=bool)) == []
    found = rules.learn_list({"x": np.tile(np.arange(30.0), 9)}, np.tile(np.arange(30) > 20, 9))
    assert [[(c.name, c.at_least) for c in rule] for rule in found] == [[("x", True)]]
