"""Every operator over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from lodestar.llm import langid, line_frequency, minhash, packing, pii, suffix_dedup, token_rollup, toxicity, warc, winnowing


def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven"), (1, "three"), (None, "日本語"), (3, None), (4, "...")], "item_id long, text string")


def model(spark):
    docs = spark.createDataFrame([(i, f"this is an english text number {i}" if i % 2 else f"voici un texte en langue française {i}", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    return langid.fit(docs)


def toxic_model(spark):
    docs = spark.createDataFrame([(i, f"a plain sentence with words {i} and more " + ("you idiot" if i % 4 == 0 else "friend")) for i in range(80)], "doc_id long, text string")
    return toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))


RUNS = {
    "lines": lambda s, d: line_frequency.line_frequency_filter(d),
    "lines_digest": lambda s, d: line_frequency.line_frequency_filter(d, with_text=False),
    "pack": lambda s, d: packing.pack_documents(d),
    "toxic": lambda s, d: toxicity.score(d, toxic_model(s)),
    "suffix": lambda s, d: suffix_dedup.remove_repeats(d),
    "rollup": lambda s, d: token_rollup.maintain(d).totals(),
    "winnow": lambda s, d: winnowing.find_overlaps(d, bench(s)),
    "decontaminate": lambda s, d: winnowing.decontaminate(d, bench(s)),
    "langid": lambda s, d: langid.detect(d, model(s)),
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "dedup": lambda s, d: minhash.deduplicate(d),
    "pii": lambda s, d: pii.detect(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, odd_docs, name):
    out = RUNS[name](spark, odd_docs)
    assert len(set(map(str.lower, out.columns))) == len(out.columns)
    rows = out.collect()
    if name not in ("pack", "rollup", "decontaminate", "dedup"):
        assert len(rows) == 9


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, empty_docs, name):
    assert RUNS[name](spark, empty_docs).count() == 0


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_defined_results(spark, odd_docs):
    lines = by_id(line_frequency.line_frequency_filter(odd_docs), "n_words", "base_failed", "kept", "text")
    assert lines[1] == (0, True, False, None) and lines[4][:3] == (60000, True, False)
    lang = by_id(langid.detect(odd_docs, model(spark)), "lang_pred", "score")
    assert lang[1] == lang[2] == lang[3] == ("und", 0.0) and lang[6][0] != "und"
    near = by_id(minhash.near_duplicates(odd_docs), "n_shingles", "component_id", "kept")
    assert near[1] == (0, 1, True) and near[7] == (3, 5, False) and near[None] == (1, None, True) and near[4] == (1, 4, True)
    over = by_id(winnowing.find_overlaps(odd_docs, bench(spark)), "n_words", "n_hit", "items")
    assert over[1] == (0, 0, []) and over[5] == (7, 7, ["1"]) and over[6] == (5, 1, [""])
    found = by_id(pii.detect(odd_docs), "n_email", "spans", "text")
    assert found[1] == (0, "", None) and found[2] == (0, "", "")
    cut = by_id(suffix_dedup.remove_repeats(odd_docs), "n_bytes", "n_removed", "kept")
    assert cut[1] == (0, 0, b"") and cut[4][0] == cut[4][1] == 300000
    totals = {(r["source"], r["lang"]): r["documents"] for r in token_rollup.maintain(odd_docs).totals().collect()}
    assert totals == {("a", "en"): 4, (None, None): 1, ("b", "fr"): 1}


def test_learning_from_nothing(spark, odd_docs, empty_docs):
    assert {r["lang_pred"] for r in langid.detect(odd_docs, langid.fit(empty_docs)).collect()} == {"und"}
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, nothing)).select(F.col("score")).collect()} == {0.0}


def test_archives_of_odd_pages(spark):
    big = "x" * 150
    rows = [(3, "http://a b/é", big, 1), (1, "u", big, 1), (1, None, big, 1), (2, "u", "y" * 99, 1), (5, "u", "y" * 99, 1), (None, "u", big, 1), (7, "u", None, 1), (8, "u", "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 20, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    for version in (1, 2):
        got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages, version=version).collect()), key=str)
        assert got == sorted([(1, 150, "response", None)] * 2 + [(3, 150, "revisit", 1), (None, 150, "revisit", 1), (2, 99, "response", None), (5, 99, "response", None), (7, 0, "response", None), (8, 480 - 20, "response", None)], key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_several_benchmark_blocks_agree_with_one(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    run = lambda: sorted(map(str, winnowing.find_overlaps(docs, items, keep=["doc_id"]).collect()))
    one = run()
    monkeypatch.setattr(winnowing, "BLOCK_BYTES", 4000)
    assert run() == one


def test_shuffle_joins_agree_with_broadcasts(spark, sf, monkeypatch):
    from lodestar.llm import _store

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    near = lambda: sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    cut = lambda: sorted(map(tuple, suffix_dedup.remove_repeats(docs, keep=["doc_id"], with_kept=False).collect()))
    a, b = near(), cut()
    monkeypatch.setattr(_store, "BROADCAST_ROWS", -1)
    assert near() == a and cut() == b
