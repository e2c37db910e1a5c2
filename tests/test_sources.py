"""Sheets, caches, sinks with guarantees, and article files."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import select
from lodestar.sources import articles, sheets


def test_article_files_by_number_with_a_broken_one(spark, tmp_path):
    body = "<article><front><article-meta><article-id pub-id-type='pmid'>7</article-id></article-meta></front><body><sec><p>a b c</p></sec></body></article>"
    for n, text in ((10, body), (9, "<article><front>"), (100, body.replace("a b c", "x"))):
        (tmp_path / f"PMC{n}.xml").write_text(text)
    (tmp_path / "other.xml").write_text(body)
    rows = {r["id"]: r for r in articles.article_files(spark, str(tmp_path)).collect()}
    assert {k: (r["status"], r["body_words"]) for k, r in rows.items()} == {"PMC9": ("parse_error", None), "PMC10": ("ok", 3), "PMC100": ("ok", 1)}
    assert rows["PMC10"]["pmid"] == "7" and rows["PMC10"]["dates"] == {} and rows["PMC10"]["authors"] == []
    assert {r["id"] for r in articles.article_files(spark, str(tmp_path), limit=2).collect()} == {"PMC9", "PMC10"}
    assert [r["id"] for r in articles.article_files(spark, str(tmp_path), ids=["PMC100"]).collect()] == ["PMC100"]


def test_nested_documents_keep_their_own(spark):
    markup = "<article><front><article-meta><title-group><article-title>Main</article-title></title-group></article-meta></front><body><p>one</p><sub-article><body><sec><p>two three</p></sec></body></sub-article></body><back><ref-list><ref/><ref-list><ref/></ref-list></ref-list></back><response><back><ref-list><ref/></ref-list></back></response></article>"
    found = articles.article(markup)
    assert (found["title"], found["body_words"], found["sections"], found["references"]) == ("Main", 1, 0, 2)


def test_book_chapters_and_null_markup(spark):
    book = "<PubmedBookArticle><BookDocument><Book><BookTitle>B</BookTitle><PubDate><Year>2011</Year></PubDate></Book><ArticleTitle>C</ArticleTitle></BookDocument></PubmedBookArticle>"
    rows = {r["id"]: r for r in articles.citations(spark.createDataFrame([(1, book), (2, None)], "id long, markup string")).collect()}
    assert (rows["1"]["title"], rows["1"]["journal"], rows["1"]["year"]) == ("C", "B", "2011") and rows["2"]["status"] == "parse_error"


def test_sheets_change_only_what_they_may(spark, tmp_path):
    path = str(tmp_path / "sheet")
    df = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id long, text string, label int")
    df.write.parquet(f"{path}/v00000001")
    now = sheets.rewrite_sheet(sheets.current_sheet(spark, path), spark.createDataFrame([(2, 1)], "id long, label int"), "id", ["label"], path)
    assert sorted(map(tuple, now.collect())) == [(1, "a", None), (2, "b", 1)]
    again = sheets.rewrite_sheet(now, spark.createDataFrame([(1, 2)], "id long, label int"), "id", ["label"], path)
    assert sorted(map(tuple, again.collect())) == [(1, "a", 2), (2, "b", 1)]
    with pytest.raises(ValueError, match="text"):
        sheets.rewrite_sheet(now, spark.createDataFrame([(2, "x")], "id long, text string"), "id", ["label"], path)
    with pytest.raises(ValueError, match="answers"):
        sheets.sheet(spark, str(tmp_path / "answer_KEY.jsonl"), "id long")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id long, tags array<string>")
    path = str(tmp_path / "grow")
    sheets.append(df, path)
    sheets.append(df, path)
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(ValueError):
        sheets.append(df.select("id"), path)
    aside = sheets.backup(spark, path)
    assert not sheets.exists(spark, path) and spark.read.parquet(aside).count() == 4 and sheets.backup(spark, path) is None
    assert sheets.guard_output("out/x.csv", ["data/raw"]) == "out/x.csv"
    for bad in ("a/data/raw/x", "out/../data"):
        with pytest.raises(ValueError):
            sheets.guard_output(bad, ["data/raw"])


def test_files_are_verified_by_digest(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"abd")
    good = hashlib.md5(b"abc").hexdigest()
    expected = spark.createDataFrame([("a.bin", good.upper()), ("b.bin", good), ("c.bin", good)], "name string, md5 string")
    found = sheets.verified(spark.read.format("binaryFile").load(str(tmp_path / "*.bin")), expected)
    assert {r["name"]: r["state"] for r in found.collect()} == {"a.bin": "ok", "b.bin": "damaged", "c.bin": "missing"}


def test_listings_shards_and_matrices(spark, tmp_path):
    keys = spark.createDataFrame([("p/PMC1.2.json",), ("p/PMC1.10.json",), ("p/PMC2.1.json",), ("p/else",)], "key string")
    assert {r["id"]: r["version"] for r in sheets.newest_listed(keys, "key", r"(PMC\d+)\.(\d+)\.json$").collect()} == {"PMC1": 10, "PMC2": 1}
    for name, n in (("s0", 2), ("s1", 3)):
        np.save(tmp_path / f"{name}.npy", np.arange(n * 2, dtype="float32").reshape(n, 2))
    vectors = sheets.npy_rows(spark, str(tmp_path))
    docs = spark.createDataFrame([("s0", 0, "a"), ("s0", 1, "b"), ("s1", 0, "c"), ("s1", 1, "d"), ("s1", 2, "e")], "shard string, place long, text string")
    assert {r["text"]: (r["position"], r["embedding"]) for r in sheets.sharded(docs, vectors).collect()}["d"] == (3, [2.0, 3.0])


def test_benchmarks_of_three_shapes(spark):
    a = sheets.memory(spark, [("1", "q", {"A": "x", "B": "y"}, "B")], "id string, question string, options map<string,string>, answer_idx string")
    b = sheets.memory(spark, [("2", "q", "x", "y", "z", "w", 2)], "id string, question string, opa string, opb string, opc string, opd string, cop int")
    both = sheets.benchmark(a, "letters").unionByName(sheets.benchmark(b, "columns"))
    assert {r["qid"]: (r["gold"], r["options"]["B"]) for r in both.collect()} == {"1": ("B", "y"), "2": ("C", "y")}
    assert sheets.with_rows(both, 2).count() == 2
    with pytest.raises(ValueError):
        sheets.with_rows(both, 3)


def test_paired_texts_say_why_not(spark):
    rows = [("1", "q", "old", "2001", "new", "2010-05"), ("2", "q", None, "2001", "new", "2010"), ("3", "q", "old", "n.d.", "new", "2010"), ("4", "q", "old", "2010", "new", "2010")]
    df = spark.createDataFrame(rows, "k string, q string, o string, od string, n string, nd string")
    fields = {"id": "k", "question": "q", "older_text": "o", "older_date": "od", "newer_text": "n", "newer_date": "nd"}
    keep, skipped = sheets.paired_texts(df, fields, "external set")
    assert [(r["id"], r["older_year"], r["newer_year"]) for r in keep.collect()] == [("1", 2001, 2010)]
    assert {r["reason"]: r["n"] for r in skipped.collect()} == {"missing text": 1, "missing or unparseable date": 1, "newer side is not newer": 1}
    with pytest.raises(ValueError):
        sheets.paired_texts(df, fields, "Curated by us")


def test_caches_and_nested_records(spark, tmp_path):
    lines = spark.createDataFrame([('{"qid":"1","candidates":["bare text",{"text":"t","score":0.5,"metadata":{"year":"2001"}}]}',)], "value string")
    sets = sheets.nested(lines)
    row = sets.first()
    assert row["candidates"][0]["text"] == "bare text" and row["candidates"][1]["metadata"] == {"year": "2001"}
    assert sheets.nested(sheets.flat_json(sets)).first() == row
    path = str(tmp_path / "cache")
    sheets.write_cache(sets, path, "f1")
    assert sheets.read_cache(spark, path, "f1").first() == row
    with pytest.raises(ValueError):
        sheets.read_cache(spark, path, "f2")
    assert sheets.read_cache(spark, path, "f2", allow_mismatch=True).count() == 1


def test_manifest_report_registry_and_endpoint(spark):
    row = sheets.manifest(spark, {"b": 1, "a": 2}, {"docs": "x"}, ["run", "it"]).first()
    assert row["config"] == '{"a": 2, "b": 1}' and row["command"] == "run it" and "spark.sql" in row["settings"]
    text = sheets.markdown(spark.range(5).select("id", F.lit("a|b").alias("t")), ["id", "t"], 2)
    assert text.splitlines()[-1] == "2 of 5 rows" and "a\\|b" in text
    loaders = sheets.Registry("loader")
    loaders.register("one")(len)
    assert loaders.get("one") is len
    with pytest.raises(ValueError, match="one"):
        loaders.get("two")
    with pytest.raises(ValueError):
        loaders.register("one")(len)
    assert sheets.endpoint("stub", "http://local", None, 0, []) == ""
    assert sheets.endpoint("remote", "http://bad.example", None, 0.5, ["bad.example"]) == "not greedy; refused host; no key"


def test_fallback_refuses_unknown_modes(spark):
    with pytest.raises(ValueError, match="keep_top1"):
        select.with_fallback(spark.createDataFrame([(1, 1, True)], "q long, rank int, kept boolean"), "q", "rank", "kept", "drop")
