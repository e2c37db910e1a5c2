"""Pruned BM25 against every pair scored."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import impact, retrieve


def corpus(spark, n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, rng.choices(words, weights, k=rng.randrange(5, 120))) for i in range(n)] + [(n, []), (n + 1, None)]
    asked = [(q, t) for q in range(12) for t in {*rng.choices(words, weights, k=8), rng.choice(words[300:])}] + [(90, "unknown"), (91, "w0")]
    return spark.createDataFrame(docs, "id long, t array<string>"), spark.createDataFrame(asked, "q long, term string")


@pytest.mark.parametrize("n, k, block", [(40, 5, 8), (1500, 10, 8), (1500, 3, 64), (1500, 2000, 8)])
def test_the_same_best_documents(spark, monkeypatch, n, k, block):
    monkeypatch.setattr(impact, "BLOCK", block)
    docs, asked = corpus(spark, n, n + k)
    index = impact.build(docs, "id", F.coalesce("t", F.array()), max_ratio=0.6)
    found, scored = impact.search(index, asked, "q", "id", k)
    postings, _ = retrieve.bm25_index(docs, "id", F.coalesce("t", F.array()), 0.6)
    every = retrieve.bm25(postings, asked, "q", "id")
    want = retrieve.top(every, ["q"], [F.desc("score"), F.col("id")], k)
    rows = lambda df: sorted((r["q"], r["rank"], r["id"], r["score"]) for r in df.collect())
    assert rows(found) == rows(want)
    pairs = every.count()
    assert scored.count() == scored.distinct().count() <= pairs
    if (n, k, block) == (1500, 3, 64):
        assert scored.count() * 5 < pairs
