"""Work of pairs: parts follow the number of pairs, and texts are read through once."""

from pyspark.sql import functions as F

from lodestar import catalog
from lodestar.operators import retrieve


def test_parts_follow_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "PAIRS", 50)
    hits = spark.createDataFrame([(i, "a") for i in range(60)] + [(1, "b")], "id long, term string")
    asked = spark.createDataFrame([(i, "a") for i in range(10)] + [(1, "c")], "q long, term string")
    assert retrieve.pair_parts(hits, asked) == 12
    assert retrieve.pair_parts(hits.where("false"), asked) == 4


def test_scores_do_not_depend_on_the_parts(spark, sf, monkeypatch):
    rows = lambda n: sorted(map(tuple, catalog.QUERIES[n](spark, sf).collect()))
    first = rows("lexical_top20")
    monkeypatch.setattr(retrieve, "PAIRS", 500)
    assert rows("lexical_top20") == first


def test_index_reads_texts_once(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c")], "id long, text string")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in retrieve.bm25_index(docs, "id", F.split("text", " "), 1.0)]
    assert not any("split(" in p for p in plans)


def test_easy_negatives_index_no_corpus(spark, sf, monkeypatch):
    monkeypatch.setattr(retrieve, "bm25_index", None)
    assert catalog.QUERIES["easy_negatives"](spark, sf).count() > 0
