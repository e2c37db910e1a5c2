"""Exact vector search: tiles, heads and ties against the specification."""

import numpy as np
import pytest

from lodestar.operators import retrieve


@pytest.mark.parametrize("tile", [3, 512])
@pytest.mark.parametrize("group", [None, "g"])
def test_heads_equal_the_specification(spark, monkeypatch, tile, group):
    monkeypatch.setattr(retrieve, "TILE", tile)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 6) / 7).tolist(), i % 3) for i in range(120)] + [(i, [0.1, 0.2, 0.3, 0.1, 0.2, 0.3], 1) for i in range(120, 140)] + [(140, None, 1)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>, g int").repartition(3)
    queries = corpus.where("id % 10 = 0 and embedding is not null").selectExpr("id as query_id", "embedding as query")
    by = ["query_id", *([group] if group else [])]
    want = retrieve.top(retrieve.knn_pairs(queries, corpus.where("embedding is not null")), by, [retrieve.F.desc("score"), retrieve.F.col("id")], 4)
    keys = [*by, "id", "score", "rank"]
    rows_of = lambda df: sorted(tuple(r) for r in df.select(*keys).collect())
    assert rows_of(retrieve.knn(queries, corpus, 4, group, block=5)) == rows_of(want)


def test_a_tile_is_scored_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    matrix, head = rng.normal(size=(2048, 64)), None
    tracemalloc.start()
    for at in range(0, 10_000, retrieve.TILE):
        vectors = rng.normal(size=(retrieve.TILE, 64))
        head = retrieve._better(head, matrix, vectors, np.arange(at, at + retrieve.TILE), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(head[0]) == 2048 * 5 and peak < 60 << 20
