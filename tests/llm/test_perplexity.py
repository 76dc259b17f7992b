"""The Kneser-Ney model against a plain version, both ways of scoring, and the defined cases."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidepool.llm import perplexity as kn
from tidepool.session import scratch_path


def plain_model(words, order=kn.ORDER):
    """p(c | h) of an interpolated modified Kneser-Ney model over (word, n)."""
    raw = Counter()
    for word, n in words.items():
        s = kn.START + word + kn.END
        for i in range(1, len(s)):
            raw[s[max(0, i - order + 1):i + 1]] += n
    tables = {order: {g: c for g, c in raw.items() if len(g) == order}}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
        tables[k].update({g: c for g, c in raw.items() if len(g) == k and g[0] == kn.START})
    symbols = len(tables[1]) + 1
    cuts, contexts = {}, {}
    for k, table in tables.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        cuts[k] = [min(max(j - (j + 1) * y * n[j + 1] / n[j] if n[j] else 0.5 * j, 0.1), j) for j in (1, 2, 3)]
        groups = defaultdict(list)
        for g, c in table.items():
            groups[g[:-1]].append(c)
        contexts[k] = groups

    def p(h, c):
        if h is None:
            return 1 / symbols
        k = len(h) + 1
        lower = p(h[1:] if h else None, c)
        held = contexts[k].get(h)
        if not held:
            return lower
        cut = lambda x: cuts[k][min(x, 3) - 1]
        count = tables[k].get(h + c, 0)
        return ((count - cut(count)) if count else 0) / sum(held) + sum(map(cut, held)) / sum(held) * lower
    return p


def plain_log(p, word):
    s = kn.START + word + kn.END
    return sum(math.log(p(s[max(0, i - kn.ORDER + 1):i], s[i])) for i in range(1, len(s)))


def corpus():
    rng = random.Random(3)
    parts = {"en": ["the", "er", "ing", "st", "on"], "fr": ["eau", "le", "oi", "ment", "è"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for k in range(120):
        lang = "en" if k % 2 else "fr"
        text = " ".join(word(lang) for _ in range(rng.randint(5, 40)))
        if k % 10 == 9:
            text = " ".join("".join(rng.choice("#xqz!7") for _ in range(6)) for _ in range(20))
        docs.append((k, text, lang))
        if k % 3:
            labels.append((k, int(k % 10 != 9), int(k % 17 == 0)))
    return docs, labels


ODD = [(500, None, "en"), (501, "", "en"), (502, " \n", "fr"), (503, "The er\x0bing", "en"), (503, "The er\x0bing", "en"), (None, "on st", "en"), (504, "wort", "de"), (505, "eau", None),
       (506, "thing " * 20_000, "en")]


def frames(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs + ODD, "doc_id long, text string, lang string").selectExpr("*", "1 as id", "'t' as trusted")
    return df, spark.createDataFrame(labels + [(1, 1, None), (None, 1, 0), (504, 0, 0)], "doc_id long, quality int, toxic int"), docs + ODD, labels


def test_probabilities_and_perplexities_as_the_plain_model(spark):
    df, lf, docs, labels = frames(spark)
    bad = {k for k, q, t in labels if q != 1 or t}
    trusted = {k for k, _, _ in labels} - bad
    words = defaultdict(Counter)
    for k, text, lang in docs:
        if k in trusted and text:
            words[lang].update(kn.words_of(text))
    models = {lang: plain_model(w) for lang, w in words.items()}
    for p in models.values():  # every context's probabilities, with the unseen symbol, sum to one
        seen = {c for w in words["en"] | words["fr"] for c in w}
        assert sum(p("", c) for c in seen) <= 1.0001
    out = kn.perplexities(df, lf).collect()
    assert len(out) == len(docs)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    for k, text, lang in docs:
        own = kn.words_of(text) if text else []
        r = by[k][0]
        assert r.n_symbols == sum(map(len, own)) + len(own)
        if own and lang in models:
            assert r.perplexity == pytest.approx(math.exp(-sum(plain_log(models[lang], w) for w in own) / r.n_symbols), rel=1e-9)
        else:
            assert r.perplexity is None and r.kept == bool(own)
    junk = [by[k][0].kept for k in range(9, 120, 10)]
    assert not any(junk) and all(by[k][0].kept for k in trusted if by[k][0].perplexity < by[k][0].threshold)
    assert len(by[503]) == 2 and by[505][0].lang == "und"
    joined = {(r.doc_id, r.n_symbols, r.kept): r.perplexity for r in kn.perplexities(df, lf, model_rows=0).collect()}
    assert joined.keys() == {(r.doc_id, r.n_symbols, r.kept) for r in out}
    for r in out:
        assert joined[(r.doc_id, r.n_symbols, r.kept)] == (None if r.perplexity is None else pytest.approx(r.perplexity, rel=1e-9))


def test_empty_tables(spark):
    df, lf, docs, _ = frames(spark)
    assert kn.perplexities(df.limit(0), lf).count() == 0
    none = kn.perplexities(df.limit(40), lf.limit(0)).collect()
    assert all(r.perplexity is None and r.kept for r in none)


def test_insults_in_clean_prose(spark):
    rng = random.Random(11)
    parts = ["the", "er", "ing", "st", "on", "ble", "and", "wh"]
    insults = ["Idiot,", "clown", "pathetic!", "«moron»"]
    docs, labels, toxic, clean = [], [], [], []
    for k in range(500):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(150)]
        bad = k % 4 == 0
        for _ in range(2 * bad):
            words[rng.randrange(60, 75)] = rng.choice(insults)
        docs.append((k, " ".join(words), "en"))
        if k < 320:
            labels.append((k, 1, int(bad)))
        else:  # nothing was learnt from these
            (toxic if bad else clean).append(k)
    df, lf = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in kn.perplexities(df, lf).collect()}
    assert not any(out[k].kept for k in toxic)
    assert sum(out[k].kept for k in clean) >= 0.95 * len(clean)
    joined = {r.doc_id: r for r in kn.perplexities(df, lf, model_rows=0).collect()}
    assert all(joined[k].kept == r.kept and joined[k].toxicity == pytest.approx(r.toxicity, abs=1e-8) for k, r in out.items())
    assert sum(r.toxicity > 0 for r in out.values()) >= 125
    no_toxic = kn.perplexities(df, lf.where("toxic = 0")).where("toxicity > 0").count()
    assert no_toxic == 0


def test_worst_span_is_of_consecutive_terms():
    weights = {b"a": 1.0, b"b": 2.0}
    text = "A, b" + " x" * kn.SPAN + " b " + "x " * (kn.SPAN - 2) + "(b)" + " x a"
    assert kn.worst_span(weights, text) == 4.0
    assert kn.worst_span(weights, "x") == kn.worst_span({}, text) == 0.0


def test_terms_alike_in_spark_and_python(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aZ9é«»—“”’_-·ªµº×ß中。 \t\n.#[]`{|\x7f\xa0\u2028") for _ in range(60)) for _ in range(200)] + ["", " ", "idiot### (clown), moron"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for r in df.select("text", kn._terms(F.col("text")).alias("terms")).collect():
        assert [x.decode() for x in kn.terms_of(r.text)] == r.terms


def test_digits_are_told_apart(spark):
    docs = [(k, "room 10 and room 10 by road 10", "en") for k in range(20)] + [(50, "room 10 and road 10", "en"), (51, "room 97 and road 97", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lf = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.perplexity for r in kn.perplexities(df, lf).collect()}
    assert out[51] > 1.5 * out[50]
    joined = {r.doc_id: r.perplexity for r in kn.perplexities(df, lf, model_rows=0).collect()}
    assert joined[51] == pytest.approx(out[51], rel=1e-9)


def test_words_scored_by_shards_and_pieces_as_the_plain_model(spark, monkeypatch):
    rng = random.Random(8)
    letters = "abcdeéß\x00\U0001F600中"
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    learnt = {lang: Counter(word(9) for _ in range(300)) for lang in ("xx", "yy")}
    asked = {lang: list(learnt[lang])[:50] + [word(9) + "?" + word(3) for _ in range(50)] + ["?", "?!a", word(300), "a" * 64] for lang in learnt}
    plain = {lang: plain_model(w) for lang, w in learnt.items()}
    made = scratch_path(spark, "kn-test-model")
    kn.write_model(spark.createDataFrame([(lang, w, n) for lang, of in learnt.items() for w, n in of.items()], "lang string, word string, n long"), made)
    model = spark.read.schema("lang string, kind string, gram string, v double").parquet(made)
    n = model.count()
    spark.createDataFrame([], "term string, weight double").write.parquet(terms := scratch_path(spark, "kn-test-terms"))
    for model_rows, room in ((10 * n, None), (n // 3, None), (n // 3, 0), (1, 0)):
        path = scratch_path(spark, "kn-test-shards")
        shards = kn.shard_model(model, path, model_rows)
        assert (len({x for of in shards.values() for x in of.values()}) > 1) == (model_rows < n)
        scorer = kn.Scorer(path, shards, model_rows if room is None else room, terms, True)
        assert bool(scorer.block) == (room == 0) and len(scorer.held) == (0 if room == 0 else len({x for of in shards.values() for x in of.values()}))
        for symbols in (kn.SYMBOLS, 20):
            monkeypatch.setattr(kn, "SYMBOLS", symbols)
            for lang, words in asked.items():
                assert scorer.log_p(lang, words).tolist() == pytest.approx([plain_log(plain[lang], w) for w in words], rel=1e-9)
        monkeypatch.undo()


def test_texts_are_neither_staged_nor_dealt_however_large_the_model(spark, monkeypatch):
    import glob
    import os

    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(2000)), "en") for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lf = spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    staged = lambda: {x: os.path.getsize(x) for x in glob.glob(f"{os.path.dirname(scratch_path(spark, 'kn'))}/kn-*/**/*.parquet", recursive=True)}
    before = staged()
    out = kn.perplexities(df, lf, model_rows=100)
    assert sum(n for x, n in staged().items() if x not in before) < sum(len(text) for _, text, _ in docs) / 4
    assert out.count() == 200
    monkeypatch.setattr(kn, "TRUSTED_IDS", 10)
    ids = kn.judged_ids(lf)
    parts = kn._judged(df.withColumnRenamed("doc_id", "id"), ids, ids.count())
    assert len(parts) == 5 and sorted(r.id for part in parts for r in part.collect()) == list(range(50))
    for part in parts:
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner" in plan and "rightHint=(strategy=broadcast)" in plan


def test_many_identifiers_and_terms_give_the_same(spark, monkeypatch):
    df, lf, docs, _ = frames(spark)
    rows = lambda: sorted(((r.doc_id is None, r.doc_id, r.lang, r.n_symbols, r.kept) + tuple(None if x is None else round(x, 9) for x in (r.perplexity, r.threshold, r.toxicity, r.toxicity_limit))
                           for r in kn.perplexities(df, lf).collect()), key=str)
    usual = rows()
    assert any(r[7] for r in usual)
    monkeypatch.setattr(kn, "TRUSTED_IDS", 9)
    assert rows() == usual
    monkeypatch.setattr(kn, "TERMS", 0)
    assert rows() == usual
