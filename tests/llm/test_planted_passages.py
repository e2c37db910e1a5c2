"""Passages of over 50 words planted in otherwise different documents: caught from 400 bytes on, as the contract has it, and clean documents left alone."""

import random

import pytest

from lodestar.llm import suffix_dedup


@pytest.mark.parametrize("size", [300, 399, 400, 401, 800])
def test_passages_are_caught_from_400_bytes_on(spark, size):
    rng = random.Random(size)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(400)[: size - 1] + "#"
    assert len(passage.split()) > 50
    # the bytes beside the passage are different in each document, so it is shared alone
    rows = [(i, f"{text(150)} {chr(65 + i)}{passage}{chr(65 + i)} {text(150)}") for i in range(30)] + [(i, text(300)) for i in range(100, 130)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"], with_kept=False).collect()}
    assert all(got[i] == (0, 0) for i in range(100, 130))
    assert all(got[i] == ((size, 1) if size >= 400 else (0, 0)) for i in range(30)), {k: v for k, v in got.items() if v[0]}
