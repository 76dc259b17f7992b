"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute_fingerprint, brute_links, groups

import numpy as np

SF = "/root/testdata/sf0.001"


def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "benchmark", "packing"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, seen[-1], SF).collect(), docs.schema)
        assert after.columns == columns
        seen.append(after)
    texts = [{r.doc_id: r.text for r in x.collect()} for x in seen]
    assert set(texts[1]) == {k for k, t in texts[0].items() if t and any(c.isalpha() for c in t)}
    gone = brute_lines(sorted(texts[1].items()), 2, 40)
    cut = {k: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[k]) for k, t in texts[1].items()}
    assert texts[2] == {k: cut[k] for k in cut if len(gone[k]) < len(texts[1][k].split("\n"))}
    fps = {k: brute_fingerprint(t) for k, t in texts[2].items()}
    points = np.unique(np.array(list(fps.values()), dtype=np.uint64))
    top = groups(points.tolist(), brute_links(points, 4))
    least = {}
    for k in sorted(fps):
        least.setdefault(top[fps[k]], k)
    assert texts[3] == {k: texts[2][k] for k in least.values()}
    assert texts[4] == {k: t for k, t in texts[3].items() if not brute_hits(t, items)[4]}
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF).collect()
    assert {r.doc_id for r in packed} == set(texts[4])
    final = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in final.collect()) == sorted((r.doc_id, r.piece, r.n_tokens) for r in packed)


def test_empty_documents(spark, tmp_path):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
