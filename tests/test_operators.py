import math

import pytest
from pyspark.sql import functions as F

from lodestar.catalog import QUERIES
from lodestar.functions import dates
from lodestar.functions import text as X
from lodestar.operators import admit, compare, layers, quality, retrieve, stats
from lodestar.plans import evidence
from lodestar.sources import files, markup
from lodestar.streaming import ingest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_word_windows_follow_the_rule(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    docs = spark.createDataFrame([(1, words(5)), (2, words(256)), (3, words(257)), (4, words(480)), (5, words(700)), (6, ""), (7, None)], "doc_id long, text string")
    got = {}
    for r in layers.chunks(docs).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append((r["window_start"], r["word_count"]))
    assert got == {1: [(0, 5)], 2: [(0, 256)], 3: [(0, 256), (224, 33)], 4: [(0, 256), (224, 256)], 5: [(0, 256), (224, 256), (448, 252)]}
    with pytest.raises(ValueError):
        layers.chunks(docs, 10, 10)


def test_year_fraction_and_bounds(spark):
    rows = spark.createDataFrame([("2020",), ("2020-02",), ("2020-02-31",), ("1400",), ("n.d.",), (None,), ("2020-02-15",)], "d string")
    low, high = dates.bounds(F.col("d"))
    got = rows.select(dates.year_fraction(F.col("d")).alias("y"), low.cast("string").alias("lo"), high.cast("string").alias("hi"), dates.precision(F.col("d")).alias("p")).collect()
    assert got[0]["y"] == 2020.5 and (got[0]["lo"], got[0]["hi"]) == ("2020-01-01", "2020-12-31")
    assert math.isclose(got[1]["y"], 2020 + (1 + 14 / 30) / 12) and got[1]["hi"] == "2020-02-29"
    assert math.isclose(got[2]["y"], 2020 + (1 + 27 / 30) / 12) and got[2]["lo"] is None
    assert got[3]["y"] is None and got[4]["y"] is None and got[5]["y"] is None and got[4]["p"] == ""


def test_compose_never_raises_precision(spark):
    rows = spark.createDataFrame([(2020, 3, 4), (2020, None, 4), (None, 3, 4)], "y int, m int, d int")
    assert [r[0] for r in rows.select(dates.compose(F.col("y"), F.col("m"), F.col("d"))).collect()] == ["2020-03-04", "2020", None]


def test_choice_takes_the_last_match_of_the_strongest_phrase(spark):
    rows = spark.createDataFrame([("The answer is A. No, the answer is (C).",), ("Option B or (D)",), ("I think B then E",), ("none",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.choice(F.col("t"))).collect()] == ["C", "B", "E", None, None]


def test_currency_states(spark):
    rows = spark.createDataFrame([(True, True, 2020.0, False), (False, False, 2020.0, False), (False, True, None, False), (False, True, 2021.0, True), (False, True, 2021.0, False), (False, True, 2030.0, False)], "r boolean, t boolean, p double, s boolean")
    value, state = admit.currency(F.col("r"), F.col("t"), F.col("p"), F.col("s"), 2026.0)
    assert [tuple(r) for r in rows.select(value, state).collect()] == [(0.0, "retracted"), (1.0, "not_time_sensitive"), (0.5, "undated"), (0.25, "superseded"), (0.5, "current"), (1.0, "current")]


def test_rank_score_edges(spark):
    rows = spark.createDataFrame([(1, 5), (5, 5), (9, 5), (None, 5), (1, 1)], "r int, d int")
    assert [r[0] for r in rows.select(admit.rank_score(F.col("r"), F.col("d"))).collect()] == [1.0, 0.0, 0.0, 0.5, 0.5]


def test_threshold_sweep_is_monotone(spark, sf):
    rows = QUERIES["threshold_sweep"](spark, sf).orderBy("config_id").collect()
    admitted = [r["admitted"] for r in rows]
    assert admitted == sorted(admitted, reverse=True)


def test_bootstrap_brackets_the_rate_and_repeats(spark, sf):
    a, b = (QUERIES["cluster_bootstrap_ci"](spark, sf).first() for _ in range(2))
    assert a == b and a["ci_low"] <= a["rate"] <= a["ci_high"] and a["draws"] == 10_000 and a["excludes_zero"] == (a["ci_low"] > 0 or a["ci_high"] < 0)


def test_binomial_is_exact(spark):
    rows = spark.createDataFrame([(3, 10), (0, 0), (5, 10), (40, 120)], "k long, n long")
    got = [r[0] for r in rows.select(stats.binomial_two_sided(F.col("k"), F.col("n"))).collect()]
    want = []
    for k, n in ((3, 10), (0, 0), (5, 10), (40, 120)):
        pmf = [math.comb(n, i) / 2**n for i in range(n + 1)]
        want.append(min(1.0, sum(p for p in pmf if p <= pmf[k] * (1 + 1e-9))))
    assert all(abs(x - y) < 1e-8 for x, y in zip(got, want, strict=True))


def test_spearman_needs_three_pairs_and_variance(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 3.0), ("c", 2.0, 2.0), ("c", 3.0, 1.0)], "g string, x double, y double")
    got = {r["g"]: r["rho"] for r in stats.spearman(rows, "x", "y", ["g"]).collect()}
    assert got == {"a": None, "b": None, "c": -1.0}


def test_contingency_of_nothing_is_null(spark):
    r = compare.contingency(spark.createDataFrame([], "a boolean, b boolean"), "a", "b").first()
    assert r["both"] == 0 and r["jaccard"] is None and r["rate_a"] is None


def test_knn_kernel_equals_its_specification_and_k_beyond_n(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0], i % 2) for i in range(7)], "id long, embedding array<float>, label int")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id long, query array<float>")
    for k in (2, 99):
        fast = sorted(map(tuple, retrieve.knn(queries, rows, k).select("query_id", "id", "score", "rank").collect()))
        slow = retrieve.top(retrieve.knn_pairs(queries, rows), ["query_id"], [F.desc("score"), F.col("id")], k)
        assert fast == sorted(map(tuple, slow.select("query_id", "id", "score", "rank").collect()))


def test_knn_reads_any_number_of_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERY_ROWS", 2)
    rows = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(9)], "id long, embedding array<float>")
    queries = rows.selectExpr("id as query_id", "embedding as query")
    fast = sorted(map(tuple, retrieve.knn(queries, rows, 3, block=4).select("query_id", "id", "score", "rank").collect()))
    slow = retrieve.top(retrieve.knn_pairs(queries, rows), ["query_id"], [F.desc("score"), F.col("id")], 3)
    assert len(fast) == 27 and fast == sorted(map(tuple, slow.select("query_id", "id", "score", "rank").collect()))
    assert retrieve.knn(queries.where("query_id < 0"), rows, 3).count() == 0


def test_searches_ask_every_fiftieth_vector(spark, sf):
    asked = {r["query_id"] for r in QUERIES["knn_topk"](spark, sf).collect()}
    assert asked == {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 50 = 0").collect()}


def test_top_k_is_cut_before_the_shuffle(spark):
    rows = spark.range(100).selectExpr("id", "id % 5 as g")
    assert "WindowGroupLimit" in plan(retrieve.top(rows, ["g"], [F.col("id")], 2))


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(QUERIES["uncovered_layer_anti"](spark, sf))
    assert "ReadSchema: struct<o_custkey:bigint>" in p
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plan(QUERIES["incremental_resume"](spark, sf))


def test_last_wins_and_duplicates(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert sorted(map(tuple, layers.last_wins(log, ["k"], ["seq"]).select("k", "v").collect())) == [("a", "y"), ("b", "z")]
    rows = spark.createDataFrame([("c1", 1, "h"), ("c2", 2, "h"), ("c3", 3, "g")], "id string, n int, sha string")
    assert {r["id"]: r["duplicate_of"] for r in layers.flag_duplicates(rows, "sha", "id", "n").collect()} == {"c1": "", "c2": "c1", "c3": ""}


def test_quality_suite_passes_and_fails(spark):
    good, bad = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, v double"), spark.createDataFrame([(1, 1.5), (1, 2.0)], "id int, v double")
    for df, passes in ((good, True), (bad, False)):
        checks = quality.unique_key(df, "id", "unique").union(quality.reproduction(df, good, ["id"], "v", 1e-5, "reproduces"))
        assert all(r["pass"] == passes for r in checks.collect())
        assert quality.gate(checks).first()["reportable"] == passes


def test_file_sources(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,title\n1,"two\nlines, and a comma"\n,blank\n1,last\n')
    files.guard(spark, str(path), ["id"])
    with pytest.raises(ValueError):
        files.guard(spark, str(path), ["other"])
    rows = files.csv(spark, str(path), ["id", "title"]).withColumn("n", F.monotonically_increasing_id())
    assert [r["title"] for r in files.keyed(rows, "id", "n").collect()] == ["last"]
    pointer = tmp_path / "p.csv"
    pointer.write_text("version https://git-lfs.github.com/spec/v1\n")
    with pytest.raises(files.PointerFile):
        files.guard(spark, str(pointer))
    for k, body in enumerate(('[{"q": "a"}, {"q": "b"}]', '{"data": [{"q": "a"}, {"q": "b"}]}')):
        (tmp_path / f"{k}.json").write_text(body)
        assert [r["q"] for r in files.records(spark, str(tmp_path / f"{k}.json"), "struct<q:string>").collect()] == ["a", "b"]
    blocks = tmp_path / "q.txt"
    blocks.write_text("# intro\n# Q1.1 first\na AND b\n# note\n# Q1.2 second\nc\n# ===\n# tail\n")
    assert sorted(map(tuple, files.query_blocks(spark, str(blocks)).collect())) == [("Q1.1", "first", "a AND b"), ("Q1.2", "second", "c")]
    report = tmp_path / "r.md"
    report.write_text("## Group: one\n| PMC1 | x |\n## Other\n| PMC9 |\n## Group: two\n| PMC2 |\n")
    assert sorted(map(tuple, files.report_groups(spark, str(report)).collect())) == [("one", "PMC1"), ("two", "PMC2")]


def test_frozen_set_refuses_tampering(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "qid string, rank int")
    files.write_jsonl(df, f"{tmp_path}/f", "qid", "rank")
    assert files.read_frozen(spark, f"{tmp_path}/f", "qid string, rank int", "qid", "rank").count() == 2
    part = next(p for p in (tmp_path / "f").iterdir() if p.suffix == ".json")
    part.write_text(part.read_text().replace("1", "3"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        files.read_frozen(spark, f"{tmp_path}/f", "qid string, rank int", "qid", "rank")


def test_float_matrix_scan(spark, tmp_path):
    import numpy as np

    np.arange(6, dtype="<f4").tofile(tmp_path / "m.f32")
    assert [list(r["embedding"]) for r in files.vectors(spark, str(tmp_path / "m.f32"), 2).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]


def test_markup(spark):
    pages = spark.createDataFrame([(1, "<p>a <b>b</b><a class='bibr'>1</a></p><table>no</table><h1>One</h1><p>x</p><h2>Two</h2>y<h1>Three</h1>z"), (2, None), (3, "<p>broken <b>")], "page_id long, html string")
    flat = {r["page_id"]: r["text"] for r in markup.flatten(pages).collect()}
    assert flat == {1: "a b[REF]1 One x Two y Three z", 2: "", 3: "broken"}
    rows = [(r["section_id"], r["title_path"], r["text"]) for r in markup.sections(pages.where("page_id = 1")).collect()]
    assert [r[1] for r in rows] == ["", "One", "One > Two", "Three"] and rows[2][2] == "y"


def test_stream_replay_changes_nothing(spark, sf, tmp_path):
    a = ingest.tumbling_counts(spark, f"{sf}/events.parquet", f"{tmp_path}/s").agg(F.sum("n")).first()[0]
    b = ingest.tumbling_counts(spark, f"{sf}/events.parquet", f"{tmp_path}/s").agg(F.sum("n")).first()[0]
    assert a == b == spark.read.parquet(f"{sf}/events.parquet").count()


def test_cap_and_abstention(spark, sf):
    capped = admit.cap(evidence.decisions(spark, sf), "user_id", 2, F.desc("score"), F.col("event_id"))
    assert capped.where("admitted").groupBy("user_id").count().where("count > 2").count() == 0
    none = admit.abstentions(evidence.decisions(spark, sf).withColumn("admitted", F.lit(False)), "user_id")
    assert none.where("not abstained").count() == 0


def test_renormalised_weights_keep_the_gate(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, 1.0, 1.0, 1.0, True), (1, 2, 1.0, 1.0, 1.0, 1.0, False)], "qid int, id int, support double, currency double, rerank double, authority double, retracted boolean")
    configs = spark.createDataFrame([("half", 0.1, 0.1, 0.0, 0.0, 0.9, True)], "config_id string, w_support double, w_currency double, w_rerank double, w_authority double, threshold double, renormalise boolean")
    assert {r["id"]: (r["admitted"], r["gate"]) for r in admit.rescore(rows, configs).collect()} == {1: (False, "retracted"), 2: (True, "")}
