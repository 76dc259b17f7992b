"""Personal data: base spans against a plain regular-expression version, term statistics by hand."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tidepool.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d >= 5) for k, d in enumerate(digits)) % 10 == 0


def brute(text):
    found = []
    for rank, (pattern, fits) in enumerate((
            (EMAIL, lambda v: True), (IP, lambda v: all(int(p) <= 255 for p in v.split("."))),
            (CARD, lambda v: 12 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(v)), (PHONE, lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15))):
        found += [(m.start(), rank, m.end()) for m in pattern.finditer(text or "") if fits(m[0])]
    return sorted(found)


def named(found):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in found)


PIECES = ["a", "bob", "@", ".", "..", "-", "_", "+", "1", "12", "255", "256", "0", "4111", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "  ", "(", ")",
          "+1 (314) 555-6532", "10.0.0.1", "999.1.1.1.2.3.4", "x.y@z.com", "é", "😀", "\n", "com", "5500005555555559", "%", "00000255"]


def test_base_spans_agree_with_plain_patterns(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["", None, "a@b.c@d.e", "a@b.c_x@d.e", "+1+2 3456789012", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.personal_data(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(named(want).encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == rank for _, k, _ in want) for rank in range(4)]
        assert set(filter(None, named(want).split(","))) <= set(filter(None, r.spans.split(",")))


def test_long_runs_neither_recurse_nor_blow_up(spark):
    texts = ["a" * 9_000, "a@" + "b." * 20_000 + "c", "1" * 9_000, "1 " * 20_000, "+1" + "(" * 50_000, "1." * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(df).collect():
        assert r.base_sha256 == hashlib.sha256(named(brute(texts[r.doc_id])).encode()).hexdigest(), r.doc_id


def test_very_many_spans_take_linear_time(spark):
    text = " ".join(f"u{k}@mail.org" for k in range(100_000))
    df = spark.createDataFrame([(1, text), (2, "zork " + text[:30_000] + " zork")], "doc_id long, text string")
    began = time.monotonic()
    rows = pii.personal_data(df).collect()
    for r, own in zip(sorted(rows), (text, "zork " + text[:30_000] + " zork")):
        assert r.base_sha256 == hashlib.sha256(named(brute(own)).encode()).hexdigest()
    assert time.monotonic() - began < 300  # seconds; adding spans to one array took 79 for 10 000


def test_contexts_are_cut_from_pieces(spark, monkeypatch):
    monkeypatch.setattr(pii, "CELL", 16)
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["😀lamp", "river", "é", "stone5", "."]) for _ in range(n))
    texts = [filler(rng.randint(0, 400)) + f" zork {k} bob@mail.org qux{k} " + filler(rng.randint(0, 20)) for k in range(40)] + [filler(30) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(df).collect():
        places = [s for s in r.spans.split(",") if s.startswith("remove:")]
        at = [m.start() for m in re.finditer("zork", texts[r.doc_id])]
        assert [f"remove:{a}:{a + 4}" for a in at] == [s for s in places if int(s.split(":")[1]) in at]


def corpus():
    near = [f"word{k} zork writes to bob@mail.org from Quillbury often" for k in range(4)]
    return near + [f"the town of Quillbury has {k} lamps" for k in range(2)] + [f"plain text writes from number {k} often" for k in range(30)]


def test_terms_that_reveal_an_entity_are_marked(spark):
    df = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    rows = {r.doc_id: r.spans.split(",") for r in pii.personal_data(df).collect()}
    # zork stands only near the address; Quillbury in 6 of 36 texts: log2(36/6) / log2(36/4) = 0.815
    assert rows[0] == ["remove:6:10", "email:21:33", "generalise:39:48"]
    assert rows[5] == [""] and rows[10] == [""]
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0] == "word0 [REMOVE] writes to [EMAIL] from Xxxxxxxxx often"
    assert clean[20] == corpus()[20]


def test_copies_are_no_evidence_and_rows_repeat(spark):
    text = "only zork knows bob@mail.org here"
    df = spark.createDataFrame([(k, text) for k in range(5)] + [(9, text)] * 3 + [(None, text), (None, None)], "doc_id long, text string")
    rows = pii.personal_data(df).collect()
    assert len(rows) == 10 and {r.spans for r in rows} == {"email:16:28", ""}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, spans string, key long")
    assert pii.personal_data(empty).count() == 0 and pii.sanitise(empty).columns == ["doc_id", "text", "spans", "key"]
    one = spark.createDataFrame([(1, "x@y.z", "s", 3)], "doc_id long, text string, spans string, key long")
    assert [tuple(r) for r in pii.sanitise(one).collect()] == [(1, "[EMAIL]", "s", 3)]


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    plan = pii.personal_data(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and F is not None
