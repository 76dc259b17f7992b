"""Record validation, sanitising, normalisation, attempts and writeback."""

import json

import pytest
from pyspark.sql import functions as F

from tidepool import contracts as C
from tidepool.operators import records as R

VOCAB = {"markets", "science"}
GOOD = {
    "enriched": True,
    "summary": "y" * 250,
    "topics": {"primary": ["science"], "secondary": ["misc"]},
    "entities": {"organizations": ["Initech"], "people": ["R. Roe"]},
}


def errors_of(spark, rec, vocab=VOCAB):
    df = spark.createDataFrame([(json.dumps(rec),)], "j string").select(F.try_parse_json("j").alias("v"))
    return R.validate(df, vocab).first()["errors"]


def test_valid_record(spark):
    assert errors_of(spark, GOOD) == []


@pytest.mark.parametrize("n,ok", [(199, False), (200, True), (20000, True), (20001, False)])
def test_summary_bounds(spark, n, ok):
    errs = errors_of(spark, {**GOOD, "summary": "s" * n})
    assert (errs == []) is ok
    if n == 199:
        assert errs == ["Field 'summary' is too short: minimum 200 characters, got 199"]
    if n == 20001:
        assert errs == ["Field 'summary' is too long: maximum 20000 characters, got 20001"]


@pytest.mark.parametrize("n,ok", [(7, True), (8, False)])
def test_max_items(spark, n, ok):
    errs = errors_of(spark, {**GOOD, "key_takeaways": ["t"] * n})
    assert (errs == []) is ok


def test_type_errors_and_missing(spark):
    rec = {"enriched": 1, "summary": 5, "topics": {"primary": "ai"}}
    errs = errors_of(spark, rec)
    assert errs == sorted([
        "Missing required field: 'entities'",
        "Field 'enriched' has wrong type: expected bool, got int",
        "Field 'summary' has wrong type: expected str, got int",
        "Field 'topics' is missing required subkey 'secondary'",
        "Field 'topics.primary' has wrong type: expected list",
    ])


def test_const_and_vocab(spark):
    rec = {**GOOD, "enriched": False, "topics": {"primary": ["science", "crypto", "crypto", {"AI": "x"}], "secondary": []}}
    errs = errors_of(spark, rec)
    assert errs == sorted([
        "Field 'enriched' must equal True, got False",
        "topics.primary item 'crypto' not in vocab",
        "topics.primary item 'crypto' not in vocab",
        "topics.primary item {'AI': 'x'} is not a string",
    ])


def test_typed_validation_agrees(spark):
    recs = [
        (True, "s" * 200, ["science"], ["Initech"], None),
        (False, "short", ["nope"], None, ["k"] * 9),
    ]
    df = spark.createDataFrame(recs, "e boolean, s string, p array<string>, o array<string>, k array<string>")
    rec = F.struct(F.col("e").alias("enriched"), F.col("s").alias("summary"),
                   F.struct(F.col("p").alias("primary"), F.array().cast("array<string>").alias("secondary")).alias("topics"),
                   F.when(F.col("o").isNotNull(), F.struct(F.col("o").alias("organizations"),
                                                            F.array().cast("array<string>").alias("people"))).alias("entities"),
                   F.col("k").alias("key_takeaways"))
    typed = R.validate_typed(df.select(rec.alias("record")), VOCAB).select("errors").collect()
    var = R.validate(df.select(R.typed_to_variant(rec).alias("v")), VOCAB).select("errors").collect()
    assert typed == var
    assert typed[0]["errors"] == []


def test_sanitize_drops_injected_and_non_strings(spark):
    rec = {**GOOD, "injected": "x", "key_takeaways": ["a", {"b": 1}, "c", "d", "e", "f", "g", "h", "i"],
           "topics": {"primary": ["science", 3], "secondary": [], "extra": ["x"]}}
    df = spark.createDataFrame([(json.dumps(rec),)], "j string").select(F.try_parse_json("j").alias("v"))
    c = df.select(R.sanitize(F.col("v")).alias("c")).first()["c"]
    assert "injected" not in c.asDict()
    assert c["key_takeaways"] == ["a", "c", "d", "e", "f", "g", "h"]
    assert c["topics"]["primary"] == ["science"]
    assert c["summary"] == "y" * 250


def test_normalize_list(spark):
    amap = R.alias_map([("globex corp", "Globex"), ("Straße AG", "Strasse Group")])
    df = spark.createDataFrame([(["Globex Corp", "globex", "Initech", "initech", "STRASSE AG"],), ([],), (None,)],
                               "a array<string>")
    got = [r[0] for r in df.select(R.normalize_list(F.col("a"), amap)).collect()]
    assert got == [["Globex", "Initech", "Strasse Group"], [], None]


def test_alias_last_wins(spark):
    amap = R.alias_map([("acme", "Acme One"), ("ACME", "Acme Two")])
    df = spark.createDataFrame([(["acme"],)], "a array<string>")
    assert df.select(R.normalize_list(F.col("a"), amap)).first()[0] == ["Acme Two"]


def _raw(rec):
    return "Sure:\n```YML\n" + json.dumps(rec) + "\n```\n"


def test_writeback_first_valid_attempt(spark):
    rows = [
        ("a.md", 1, _raw({**GOOD, "summary": "short"})),
        ("a.md", 2, _raw(GOOD)),
        ("b.md", 1, "no yaml here: [unclosed"),
        ("b.md", 2, _raw({**GOOD, "enriched": False})),
        ("c.md", 1, "just prose"),
    ]
    df = spark.createDataFrame(rows, "path string, attempt int, raw string")
    out = {r["path"]: r for r in R.writeback(df, VOCAB, []).collect()}
    assert out["a.md"]["ok"] and out["a.md"]["attempts"] == 2 and out["a.md"]["errors"] == []
    assert out["a.md"]["clean"]["entities"]["organizations"] == ["Initech"]
    assert not out["b.md"]["ok"] and out["b.md"]["attempts"] == 2
    assert out["b.md"]["errors"] == [C.MSG_NO_YAML, "Field 'enriched' must equal True, got False"]
    assert out["c.md"]["errors"] == [C.MSG_NO_YAML]


def test_upsert_keeps_unknown_and_failed(spark):
    docs = spark.createDataFrame([("a.md", "Title A", "keep", None), ("b.md", "Title B", "keep", "old summary")],
                                 "path string, title string, custom string, summary string")
    res = spark.createDataFrame([("a.md", True, json.dumps(GOOD)), ("b.md", False, json.dumps(GOOD))],
                                "path string, ok boolean, j string")
    res = res.select("path", "ok", R.sanitize(F.try_parse_json("j")).alias("clean"))
    out = {r["path"]: r for r in R.upsert_metadata(docs, res).collect()}
    assert out["a.md"]["summary"] == "y" * 250 and out["a.md"]["custom"] == "keep" and out["a.md"]["enriched"]
    assert out["b.md"]["summary"] == "old summary" and out["b.md"]["enriched"] is None


def test_ensure_list(spark):
    from tidepool.sources.scans import ensure_list
    vals = ['"x"', '["a", 1]', 'null', '5', '{"k": 1}']
    df = spark.createDataFrame([(v,) for v in vals], "j string")
    got = [r[0] for r in df.select(ensure_list(F.try_parse_json("j"))).collect()]
    assert got == [["x"], ["a", "1"], [], [], []]


def test_long_entity_lists_are_normalised_in_one_scan(spark):
    """100 000 names, half of them repeats in another casing."""
    names = [f"Name {i}" for i in range(50_000)] + [f"NAME {i}" for i in range(50_000)]
    got = spark.createDataFrame([(names,)], "e array<string>").select(R.normalize_list(F.col("e"), R.alias_map([("name 7", "Seven")])).alias("n")).first().n
    assert got == sorted([f"Name {i}" for i in range(50_000) if i != 7] + ["Seven"])


def test_alias_join_takes_the_last_alias_and_keeps_unknown_values(spark):
    ents = spark.createDataFrame([(1, 0, "THE"), (1, 1, "Other"), (2, 0, None)], "doc_id int, pos int, token string")
    aliases = spark.createDataFrame([(0, "the", "first"), (1, "The", "last"), (2, "unused", "x")], "alias_ord int, alias string, canonical string")
    assert sorted((r.doc_id, r.pos, r.canonical) for r in R.alias_join(ents, aliases).collect()) == [(1, 0, "last"), (1, 1, "Other"), (2, 0, None)]


def test_document_table_is_updated_in_place(spark, tmp_path):
    """Only the months of updated documents are written; a new session finds the table by its files."""
    from tidepool.sources import doctable as DT

    folder = tmp_path / "docs"
    docs = spark.createDataFrame([("a", "2024-01-05", "A", "old"), ("b", "2024-02-05", "B", None), ("c", None, "C", None), ("d", "2024-01-09", "D", None)],
                                 "path string, published string, body string, summary string")
    DT.store_documents(docs, "upsert_documents", str(folder), buckets=8)
    shape = "path string, ok boolean, clean struct<enriched: boolean, summary: string, topics: struct<primary: array<string>, secondary: array<string>>, " \
            "entities: struct<organizations: array<string>, people: array<string>>, key_takeaways: array<string>>"
    res = spark.createDataFrame([("a", True, (True, "new", (["ai"], []), None, None)), ("b", False, None), ("gone", True, (True, "x", None, None, None))], shape)

    def files(month):
        return sorted(f.name for f in (folder / f"month={month}").glob("*.parquet"))

    before = {m: files(m) for m in ("2024-01", "2024-02", "0000-00")}
    got = {r.path: (r.body, r.enriched, r.summary, r.topics and r.topics.primary) for r in DT.upsert_documents(spark, "upsert_documents", res).collect()}
    assert got == {"a": ("A", True, "new", ["ai"]), "b": ("B", None, None, None), "c": ("C", None, None, None), "d": ("D", None, None, None)}
    assert files("2024-02") == before["2024-02"] and files("0000-00") == before["0000-00"] and files("2024-01") != before["2024-01"]
    spark.sql("DROP TABLE upsert_documents")
    DT.open_documents(spark, "reopened_documents", str(folder), buckets=8)
    more = spark.createDataFrame([("b", True, (True, "later", None, None, ["k"]))], shape)
    got = {r.path: (r.summary, r.key_takeaways) for r in DT.upsert_documents(spark, "reopened_documents", more).collect()}
    assert got == {"a": ("new", None), "b": ("later", ["k"]), "c": (None, None), "d": (None, None)}
    spark.sql("DROP TABLE reopened_documents")


def test_first_fenced_block_of_any_answer(spark):
    answers = ["x ```YAML \n\n a: 1\n``` y ```yml\nb: 2\n```", "```yml\nopen: 1", "``` yaml\nno: 1\n```", "```yaml a: 1\n```\n```yml\nc: 3```", "```yaml\n```", "", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, raw string")
    got = [r.b for r in df.select("i", R.extract_block(F.col("raw")).alias("b")).orderBy("i").collect()]
    assert got == [" a: 1\n", answers[1], answers[2], "c: 3", "", "", None]


def test_normalised_entities_run_natively_and_group_by_id_once(spark):
    """No Python worker, and one exchange less than a dedup of its own needed."""
    ents = spark.createDataFrame([(1, 0, "THE"), (1, 1, "the"), (1, 2, "ΣΑΣ"), (1, 3, "σας"), (1, 4, "ﬁx"), (1, 5, "FIX"), (2, 0, None), (None, 0, "a")], "doc_id int, pos int, token string")
    aliases = spark.createDataFrame([(0, "the", "Old"), (1, "The", "Fix")], "alias_ord int, alias string, canonical string")
    out = R.normalize_entities_table(ents, aliases)
    assert {r.doc_id: r.entities for r in out.collect()} == {1: ["Fix", "ΣΑΣ"], 2: [], None: ["a"]}
    assert "Python" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_entities_are_dealt_by_id_once(spark):
    """One exchange by the id serves all groupings; where the texts were dealt so, their words are not dealt at all."""
    import __spark_entry__ as E
    from tidepool.plans import fixtures as fx
    rows = [(1, 0, "Acme"), (1, 1, "ACME"), (1, 2, "La"), (1, 5, "acme"), (2, 0, None), (None, 0, "b"), (None, 1, "B"), (3, None, "x")] * 2
    ents = spark.createDataFrame(rows, "doc_id int, pos int, token string").repartition(3)
    out = R.normalize_entities_table(ents, fx.v_aliases(spark))
    query = E.queries()["normalize_entities"](spark, "/root/testdata/sf0.001")
    for found in (out, query):
        dealt = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(doc_id" in x]
        assert len(dealt) == 1 and "token" not in dealt[0]
    assert {r.doc_id: r.entities for r in out.collect()} == {1: ["Acme", "La Maison"], 2: [], None: ["b"], 3: []}


def test_candidate_records_are_spread_before_they_are_made(spark):
    """A table stored in one part is still worked on by all tasks."""
    from tidepool.plans import fixtures as fx
    for view in (fx.v_raw, fx.v_entities):
        plan = view(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan and plan.index("Generate") < plan.index("RepartitionByExpression")


def test_entity_groups_are_normalised_once(spark):
    """The alias lookup appears in no filter below the projection."""
    import __spark_entry__ as E
    plan = E.queries()["normalize_entity_groups"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x.split("(")[0] and "element_at" in x]
    assert "Python" not in plan
