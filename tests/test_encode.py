"""Batches by length, halving on failure, windows pooled in place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import encode


def test_calls_hold_texts_of_one_length():
    sizes = np.array([5, 100, 1, 0, 7, 90, 3000, 2])
    got = [c.tolist() for c in encode.calls(sizes, 200)]
    assert sorted(i for c in got for i in c) == list(range(8))
    assert all(len(c) == 1 or max(sizes[c]) * len(c) <= 200 for c in map(np.array, got))
    assert list(encode.calls(np.array([], np.int64), 10)) == []


def test_only_the_bad_text_fails():
    seen = []

    def model(texts):
        seen.append(len(texts))
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [len(t) for t in texts]

    texts = [["w"] * (i % 3 + 1) for i in range(40)]
    texts[17] = ["bad"]
    values, errors = encode.scored(model, texts, 10_000)
    assert errors == [None] * 17 + ["RuntimeError: no"] + [None] * 22
    assert values == [None if i == 17 else len(t) for i, t in enumerate(texts)]
    assert len(seen) <= 2 * 6 + 1  # one path of halves


def test_a_model_that_answers_wrongly_is_a_failure():
    values, errors = encode.scored(lambda texts: [1.0], [["a"], ["b"]], 10)
    assert values == [1.0, 1.0] and errors == [None, None]
    assert encode.scored(lambda texts: [], [["a"]], 10)[1] == ["ValueError: 0 values for 1 texts"]


@pytest.mark.parametrize("size, want", [(0, [0]), (5, [0]), (10, [0]), (11, [0, 7]), (17, [0, 7]), (18, [0, 7, 14])])
def test_windows_reach_the_end(size, want):
    assert encode.window_starts(size, 10, 3) == want


def test_vectors_and_errors_as_rows(spark):
    rows = [(i, "x " * (i * 10)) for i in range(30)] + [(99, None)]

    def load():
        def model(texts):
            if sum(map(len, texts)) > 200:
                raise MemoryError("full")
            return [[float(len(t)), 1.0] for t in texts]

        return model

    got = {r["id"]: (r["value"], r["error"]) for r in encode.encode(spark.createDataFrame(rows, "id long, t string"), "id", "t", load, "array<double>").collect()}
    assert got == {i: ([i * 10.0, 1.0], None) if i <= 20 else (None, "MemoryError: full") for i in range(30)} | {99: ([0.0, 1.0], None)}


def test_pooled_windows_equal_exploded_ones(spark):
    rows = [(i, " ".join(f"w{j * j % (i + 3)}" for j in range(i * 7))) for i in range(25)] + [(50, ""), (51, "bad " * 30)]

    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad")
            return [len(set(t)) for t in texts]

        return model

    df = spark.createDataFrame(rows, "id long, t string")
    got = {r["id"]: (r["value"], r["windows"], r["error"]) for r in encode.strided(df, "id", "t", load, 16, 4).collect()}
    words = F.filter(F.split("t", " "), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(words) - 16) / 12)).cast("int") * 12, F.lit(12))
    long = df.where("id < 51").select("id", words.alias("w"), F.explode(starts).alias("s")).select("id", F.size(F.array_distinct(F.slice("w", F.col("s") + 1, 16))).alias("v"))
    want = {r["id"]: (r["v"], r["n"], None) for r in long.groupBy("id").agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("n")).collect()}
    assert got == want | {51: (None, 3, "ValueError: bad")}
    with pytest.raises(ValueError, match="move on"):
        encode.strided(df, "id", "t", load, 4, 4)
