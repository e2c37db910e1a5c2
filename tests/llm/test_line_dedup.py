"""Line dedup against a plain loop, on odd rows and through both join paths."""

import pytest

from lodestar.llm import _store, line_dedup

UP, LOW = line_dedup.UPPER, line_dedup.LOWER


def by_force(texts, min_docs, min_chars=1):
    lines = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate(str.maketrans(UP, LOW))
    docs = {}
    for ls in lines:
        for k in {key(x) for x in ls}:
            docs[k] = docs.get(k, 0) + 1
    gone = {k for k, n in docs.items() if n >= min_docs and len(k) >= min_chars}
    return [(len(ls), sum(key(x) in gone for x in ls), "\n".join(x for x in ls if key(x) not in gone)) for ls in lines]


TEXTS = [None, "", "\n", "  \t", "A b\n\n a B \nc", "a b", "É\né\nİ\nς Σ", "é\nÉ", "x\ra b\x0b\na B", "a b", "a b", " a b", "ÀB\nàb\nÀb", "ÀB", "c\n" * 5, "long " * 20_000 + "\nc\n" + "A B\n" * 3000]


@pytest.mark.parametrize("min_docs, min_chars", [(2, 1), (3, 1), (2, 0), (2, 3), (100, 1)])
def test_equals_a_plain_loop(spark, min_docs, min_chars):
    docs = spark.createDataFrame([(i % 7, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = line_dedup.line_dedup(docs, min_docs=min_docs, min_chars=min_chars).collect()
    want = [(i % 7, t, *x) for i, (t, x) in enumerate(zip(TEXTS, by_force(TEXTS, min_docs, min_chars), strict=True))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_odd_rows_and_clashing_names(spark, odd_docs, empty_docs):
    docs = odd_docs.withColumnRenamed("spans", "N_Lines")
    out = line_dedup.line_dedup(docs, min_docs=3)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"][:9]) for r in out.collect()}
    assert out.count() == 9 and (1, 1, 0, "") in rows and (7, 1, 1, "") in rows and (3, 2, 0, "   \n\t ") in rows
    assert line_dedup.line_dedup(empty_docs).count() == 0


def test_shuffle_joins_agree_with_broadcasts(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    run = lambda: sorted(map(str, line_dedup.line_dedup(docs, keep=["doc_id"]).collect()))
    one = run()
    monkeypatch.setattr(_store, "BROADCAST_ROWS", -1)
    assert run() == one


def test_main_path_is_native(spark, sf):
    out = line_dedup.line_dedup(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
