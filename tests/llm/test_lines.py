"""Line dedup against a plain version: any run that has an earlier equal place."""

import random
import re

import pytest

from tidepool.llm import lines


def brute(docs, window, long_chars):
    """{doc_id: deleted positions}: lines in a run of ``window`` lines or ``long_chars`` characters that occurs earlier; doc_ids are distinct."""
    text = {d: t.split("\n") for d, t in docs if t}
    gone = {d: set() for d, _ in docs}
    earlier = set()
    for d in sorted(text, key=lambda d: (d is not None, d)):
        parts = text[d]
        for p in range(len(parts)):
            for size in range(1, window + 1):
                run = tuple(parts[p:p + size])
                if len(run) < size or all(re.fullmatch(r"[ \t\r\x0b\x0c]*", x) for x in run):
                    continue
                run = tuple("" if re.fullmatch(r"[ \t\r\x0b\x0c]*", x) else x for x in run)
                if size < window and sum(len(x) for x in parts[p:p + size]) < long_chars:
                    continue
                if run in earlier:
                    gone[d].update(range(p, p + size))
                earlier.add(run)
    return gone


def random_docs(seed, n=60):
    rng = random.Random(seed)
    pool = [f"line {k} " + "x" * rng.choice([0, 2, 50]) for k in range(25)] + ["", "  ", "a", "b"]
    blocks = [[rng.choice(pool) for _ in range(rng.randint(1, 6))] for _ in range(10)]
    out = []
    for k in range(n):
        own = []
        for _ in range(rng.randint(1, 5)):
            own += rng.choice(blocks) if rng.random() < 0.6 else [f"own {k} {rng.random()}"]
        out.append((k, "\n".join(own)))
    return out


@pytest.mark.parametrize("window", [1, 2, 3])
def test_random_documents(spark, window):
    docs = random_docs(window) + [(90, ""), (91, "\n"), (92, "alone"), (93, "a\na\na\na"), (None, "nameless first line that is long enough to count\nx")]
    docs.append((94, docs[-1][1]))
    want = brute(docs, window, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for r in lines.dedup_lines(df, window=window).collect():
        text = dict(docs)[r.doc_id]
        parts = text.split("\n") if text else []
        kept = [x for k, x in enumerate(parts) if k not in want[r.doc_id]]
        assert r.n_lines == len(parts)
        assert (r.text, r.n_deleted) == ("\n".join(kept), len(want[r.doc_id])), (r, want[r.doc_id])


def test_guarantee_for_runs_of_window_lines(spark):
    run = "\n".join(["first short", "second", "third"])
    docs = [(1, f"begin\n{run}\nend"), (2, f"other\n{run}"), (3, f"{run}\nlast"), (4, "second\nalone")]
    out = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: docs[0][1], 2: "other", 3: "last", 4: "second\nalone"}


def test_runs_are_found_whichever_document_held_their_lines_first(spark):
    """The run of 3 is in 2; its lines' first places are in 0 and 1, with other neighbours."""
    docs = [(0, "a\nx"), (1, "y\nb"), (2, "p\na\nb\nq"), (3, "a\nb"), (4, "x\na\nb\ny")]
    out = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {0: "a\nx", 1: "y\nb", 2: "p\na\nb\nq", 3: "", 4: "x\ny"}


def test_nulls_repeated_rows_clashing_columns_and_long_texts(spark):
    long_text = "\n".join(f"line number {k}" for k in range(20_000))
    data = [(1, "one line that is long enough to be deleted later\nb", 5), (1, "one line that is long enough to be deleted later\nb", 5), (2, None, 6), (3, "", 7),
            (4, "one line that is long enough to be deleted later", 8), (5, long_text, 9), (6, long_text + "\nmore", 10)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_lines long").selectExpr("doc_id", "text", "n_lines as key", "doc_id as id")
    out = [(r.doc_id, r.text, r.key, r.id, r.n_lines, r.n_deleted) for r in lines.dedup_lines(df).orderBy("doc_id").collect()]
    assert out[:2] == [(1, data[0][1], 5, 1, 2, 0)] * 2
    assert out[2:5] == [(2, None, 6, 2, 0, 0), (3, "", 7, 3, 0, 0), (4, "", 8, 4, 1, 1)]
    assert out[5][1] == long_text and out[6][1:2] == ("more",) and out[6][5] == 20_000
    assert sorted(r.doc_id for r in lines.without_repeated_lines(df).collect()) == [1, 1, 2, 3, 5, 6]
    assert lines.without_repeated_lines(df).columns == df.columns
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame(random_docs(9), "doc_id long, text string")
    assert not re.search("Python|Arrow|Pandas", lines.dedup_lines(df)._jdf.queryExecution().toString())
