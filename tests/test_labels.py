import json
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar import config
from lodestar.catalog import QUERIES
from lodestar.functions import licences
from lodestar.operators import label, model
from lodestar.sources import search


def test_config_layers(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"base": "b.json", "threshold": 0.5}))
    (tmp_path / "b.json").write_text(json.dumps({"threshold": 0.1, "half_life": 3.0}))
    got = config.load(tmp_path / "a.json", ["half_life=8.0", "device=gpu"])
    assert (got.threshold, got.half_life, got.device) == (0.5, 8.0, "gpu")
    assert got.fingerprint() == config.Config(threshold=0.5, half_life=8.0, batch_size=99).fingerprint() != config.Config().fingerprint()
    with pytest.raises(ValueError):
        config.from_mapping({"treshold": 1})
    (tmp_path / "b.json").write_text(json.dumps({"base": "a.json"}))
    with pytest.raises(ValueError):
        config.load(tmp_path / "a.json")


def test_windows_halve_until_they_page():
    count = lambda a, b: 10 * ((b - a).days + 1)
    got = search.plan_windows(count, date(2024, 1, 1), date(2024, 1, 16), 50)
    assert sum(n for _, _, n in got) == 160 and all(n <= 50 for _, _, n in got)
    assert all(b + timedelta(days=1) == c for (_, b, _), (c, _, _) in zip(got, got[1:], strict=False))
    assert search.plan_windows(lambda a, b: 99, date(2024, 1, 1), date(2024, 1, 1), 50) == [(date(2024, 1, 1), date(2024, 1, 1), 99)]


def test_fetch_isolates_the_bad_id():
    def get(ids):
        if "bad" in ids:
            raise RuntimeError("no")
        return [{"id": i} for i in ids if i != "gone"]

    got = {i: error for i, _, error in search.fetch(["a", "b", "bad", "c", "gone"], get)}
    assert got == {"a": None, "b": None, "bad": "RuntimeError: no", "c": None, "gone": "not in the answer"}


def test_retry_waits_twice_as_long():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise search.Transient
        return "ok"

    assert search.retry(call, sleep=waits.append) == "ok" and waits == [1.0, 2.0, 4.0]


def test_search_is_a_data_source(spark):
    days = lambda a, b: [f"{a + timedelta(days=k)}" for k in range((b - a).days + 1)]
    spark.dataSource.register(search.source("fixture", days, lambda ids: [{"id": i, "title": f"t{i}", "date": i} for i in ids], 3))
    rows = spark.read.format("fixture").options(start="2024-01-01", end="2024-01-10").load()
    assert rows.count() == 10 and rows.where("error is not null").count() == 0


def test_draws_are_disjoint_sized_and_repeatable(spark, sf):
    a = QUERIES["stratified_cells"](spark, sf).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, QUERIES["stratified_cells"](spark, sf).collect()))
    split = QUERIES["group_split"](spark, sf).groupBy("conv_id").agg(F.count_distinct("split").alias("n"))
    assert split.where("n > 1").count() == 0


def test_valid_prefix_and_next(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 1), ("a", 3, None), ("b", 1, 1)], "g string, n int, lab int")
    got = {r["g"]: (r["next"], r["done"], r["total"]) for r in label.next_unlabelled(rows, "g", "n", "lab", 1).collect()}
    assert got == {"a": (3, 1, 3), "b": (None, 1, 1)}
    kept = label.longest_valid_prefix(rows, "g", "n", F.col("lab").isNull()).collect()
    assert [(r["g"], r["n"]) for r in kept] == [("a", 1)]


def test_model_seam_scores_each_text_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "")], "id int, t string")
    calls = spark.sparkContext.accumulator(0)

    def load():
        def run(texts):
            calls.add(len(texts))
            return [float(len(t)) for t in texts]

        return run

    got = model.score_once(rows, ["id"], F.col("t"), model.scorer(load)).collect()
    assert {r["id"]: r["p"] for r in got} == {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.0} and calls.value == 3
    vector = rows.select(model.stub_vector(F.col("t")).alias("v")).first()["v"]
    assert abs(sum(x * x for x in vector) - 1) < 1e-9


def test_a_failing_arm_becomes_a_row(spark):
    rows = spark.createDataFrame([("q1", 1), ("q2", 2)], "qid string, x int")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if group["qid"].iloc[0] == "q2":
            raise RuntimeError("broken")
        return group[["qid", "x"]]

    got = rows.groupBy("qid").applyInPandas(model.captured(run, ["qid", "x"]), "qid string, x int, error string").collect()
    assert {r["qid"]: r["error"] for r in got} == {"q1": None, "q2": "RuntimeError: broken"}


def test_sentences_and_licences(spark):
    rows = spark.createDataFrame([("See Fig. 2 for it. Then e.g. This one. Done! (Yes) ok",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(licences.sentences(F.coalesce("t", F.lit("")))).collect()]
    assert got == [["See Fig. 2 for it.", "Then e.g.", "This one.", "Done!", "(Yes) ok"], [], []]
    refs = spark.createDataFrame([("CC BY-NC-ND 4.0",), ("cc-by",), (None,), ("mine",)], "r string")
    code = licences.code(F.col("r"))
    assert [tuple(r) for r in refs.select(code, licences.band(code, F.col("r"))).collect()] == [("cc-by-nc-nd", "cc-restrictive"), ("cc-by", "open"), ("", "none"), ("", "other")]
