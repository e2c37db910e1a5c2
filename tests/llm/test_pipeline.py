"""The pipeline stage by stage against brute force."""

import re

from test_exact import near_by_force

import corpus_pipeline
from lodestar.llm import pii, queries


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.store(stage(spark, frames[-1], sf), f"test-{name}").df)
    rows = [{r["doc_id"]: r for r in f.collect()} for f in frames[:-1]]
    assert all(f.columns == columns for f in frames[:-1])
    assert set(rows[1]) == {i for i, r in rows[0].items() if r["text"] and any(map(str.isalpha, r["text"]))}
    assert set(rows[2]) == {i for i, (_, root, _) in near_by_force([(i, r["text"]) for i, r in rows[1].items()]).items() if i == root}
    marked = {r["doc_id"] for r in queries.QUERIES["op7_winnowing"](spark, sf).collect() if r["contaminated"]}
    assert set(rows[3]) == set(rows[2]) - marked
    field = pii.trained()
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        before = rows[3][i]["text"]
        assert r["text"] == pii.redact(before, pii.find_spans(before, field)[1]) and r["n_chars"] == len(r["text"])
    pieces = frames[-1].collect()
    assert {r["doc_id"] for r in pieces} == set(rows[4])
    run = corpus_pipeline.run(spark, sf)
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, run.collect())) == sorted(map(key, pieces))


def test_stages_are_the_named_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "best_fit_packing"]
    assert re.match("(?s).*Defined cases", corpus_pipeline.__doc__)
