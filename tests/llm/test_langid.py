"""Language identification: automata against plain longest matches, held-out accuracy, defined cases."""

import random
import zlib

from pyspark.sql import functions as F

from tidepool.llm import langid
from tidepool.llm.common import read_table

SF = "/root/testdata/sf0.01"


def brute_phrases(sample, text):
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in sample:
            size += 1
        count += 1
        at += size
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(6)
    for _ in range(300):
        sample = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))
        automaton = langid.SuffixAutomaton(sample)
        for _ in range(10):
            text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30)))
            assert automaton.phrases(text) == brute_phrases(sample, text), (sample, text)


def test_a_text_counts_the_phrases_of_all_its_words(monkeypatch):
    samples = (("a", "the cat sat on the mat"), ("b", "der hund und die katze"))
    parser = langid.CrossParser(samples)
    text = "The cat, und THE dog! " * 300
    packed = sum(parser[w] for w in langid.normal_words(text))
    for k, (_, sample) in enumerate(samples):
        assert (packed >> (langid._FIELD * k)) & ((1 << langid._FIELD) - 1) == sum(brute_phrases(f" {sample} ", f" {w} ") for w in langid.normal_words(text))
    monkeypatch.setattr(langid, "CACHE_WORDS", 2)
    assert langid.CrossParser(samples).predict(text) == parser.predict(text)
    assert parser.predict("12 !") == parser.predict(None) == ("und", 0.0)


def test_held_out_accuracy_on_the_documents(spark):
    docs = read_table(spark, SF, "documents")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_is_learned_from_held_out_or_unlabelled_rows(spark):
    ids = range(400)
    keep = [i for i in ids if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "qqqq wwww" if i not in keep else "plain text", "xx" if i not in keep else "en") for i in ids] + [(None, "zzzz", "zz"), (keep[0], "rrrr", None)]
    samples = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [name for name, _ in samples] == ["en"] and "qqqq" not in samples[0][1] and "rrrr" not in samples[0][1]


def test_defined_cases(spark):
    docs = [(i, "the cat and the dog are here" if i % 2 else "der hund und die katze sind da", "en" if i % 2 else "de") for i in range(200)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "en"), (1003, "the dog", None), (1003, "the dog", None), (None, "die katze", None), (1004, "die katze " * 20_000, "en"),
           (1005, "日本語 текст", None)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {}
    for r in langid.identify(df).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.held_out))
    assert all(got[k] == [("und", zlib.crc32(str(k).encode()) % 5 == 0)] for k in (1000, 1001, 1002))
    assert [p for p, _ in got[1003]] == ["en", "en"] and got[None] == [("de", False)] and got[1004][0][0] == "de" and got[1005][0][0] in ("de", "en")
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(200)) | {1003, 1004, 1005, None}
    assert langid.identify(df.limit(0)).count() == 0 and langid.keep_identified(df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_unlabelled_documents_with_letters_are_kept(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "123 !", None), (3, None, None), (4, "été", None)], "doc_id long, text string, lang string")
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 4}
