"""Audits: planted changes are found, named, and nothing else is."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import audit

ROW = "concat_ws('|', id, q, a)"


@pytest.fixture(scope="module")
def population(spark):
    rows = [(i, i % 10, (i * 37 % 101) / 100, (i * 53 % 97) / 100, i % 50 == 3) for i in range(200)]
    return spark.createDataFrame(rows, "id long, q long, a double, b double, f boolean")


@pytest.fixture(scope="module")
def drawn(spark, population):
    again, edges = audit.draw_again(population, ["a", "b"], "id", F.col("f"), 40, 42)
    return again.drop("draw", "place", "forced"), edges.withColumns({"population": F.lit(200), "sampled": F.lit(40), "forced": F.lit(4)})


def found(population, sheet, record):
    rows = audit.sampling(sheet, population, record, ["a", "b"], "id", "q", F.col("f"), 40, 42, F.expr(ROW), 10).collect()
    return {(r["check"], r["detail"]) if r["check"].startswith(("row_", "forced_row")) else r["check"]: r["status"] for r in rows}


def test_a_true_sheet_passes(population, drawn):
    got = found(population, *drawn)
    assert {k for k, v in got.items() if v != "PASS"} == {"not_self_weighting"}


def test_planted_changes_are_each_named(population, drawn):
    sheet, record = drawn
    lost = sheet.where("f").agg(F.min("id")).first()[0]
    moved = sheet.where(f"not f and id <> {lost}").agg(F.max("id")).first()[0]
    planted = sheet.where(f"id <> {lost}").withColumn("q", F.when(F.col("id") == moved, F.col("q") + 1).otherwise(F.col("q"))).union(sheet.limit(1).withColumn("id", F.lit(-5).cast("long")))
    got = found(population, planted, record.withColumn("b_high", F.col("b_high") + 0.01).withColumn("population", F.lit(199)))
    bad = {k for k, v in got.items() if v == "FAIL"}
    assert bad == {"population_size", "edge:b_high", "sample_reproduces", ("row_missing", str(lost)), ("row_changed", str(moved)), ("row_added", "-5"), ("forced_row_missing", str(lost))}


def test_rows_are_compared_in_differing_cells_only(spark):
    left = spark.createDataFrame([(i, f"p{i % 4}", None if i % 7 == 0 else f"c{i % 3}", i) for i in range(400)], "id long, p string, c string, v long")
    right = left.withColumn("v", F.when(F.col("id") == 77, -1).otherwise(F.col("v"))).where("id <> 100").union(left.where("id = 9"))
    row = F.expr("concat_ws('|', id, v)")
    trees = [audit.digest_tree(x, ["p", "c"], row) for x in (left, right)]
    nodes = {(r["level"], r["p"], r["c"]): (r["n_left"], r["n_right"]) for r in audit.differences(*trees, ["p", "c"]).collect()}
    assert nodes == {(0, None, None): (400, 400), (1, "p0", None): (100, 99), (1, "p1", None): (100, 101), (2, "p0", "c1"): nodes[2, "p0", "c1"], (2, "p1", None): nodes[2, "p1", None], (2, "p1", "c0"): nodes[2, "p1", "c0"]}
    assert sorted(map(tuple, audit.located(left, right, ["p", "c"], "id", row).collect())) == [(9, "changed"), (77, "changed"), (100, "missing")]
    assert audit.differences(trees[0], trees[0], ["p", "c"]).count() == 0 and audit.located(left, left, ["p", "c"], "id", row).count() == 0


def test_a_null_cell_is_no_level(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "id long, p string")
    b = spark.createDataFrame([(1, "y"), (2, "x")], "id long, p string")
    trees = [audit.digest_tree(x, ["p"], F.col("id").cast("string")) for x in (a, b)]
    assert {(r["level"], r["p"], r["n_left"], r["n_right"]) for r in audit.differences(*trees, ["p"]).collect()} == {(1, None, 1, 0), (1, "y", 0, 1)}


def statuses(df):
    return {r["check"]: r["status"] for r in df.collect()}


def test_provenance(spark, population):
    row = F.expr("concat_ws('|', id, a)")
    root = audit.digest_tree(population, [], row).select("n", "digest")
    run = lambda recorded, local, good, source: statuses(audit.provenance(population, recorded, local, ["q"], row, good, F.lit(source), "scientific"))
    assert run(root, population, F.col("a") >= 0, "x/scientific/file.jsonl") == {"drawn_from_the_run": "PASS", "production_retrieval": "PASS", "source_folder": "PASS", "local_set": "PASS"}
    assert run(root.withColumn("digest", F.col("digest") + 1), None, F.lit(None).cast("boolean"), "c:\\runs\\scientific\\f") == {"drawn_from_the_run": "FAIL", "production_retrieval": "SKIP", "source_folder": "PASS", "local_set": "SKIP"}
    assert run(root, population.where("id > 0"), F.col("a") > 0.5, "/x/comparison/f") == {"drawn_from_the_run": "PASS", "production_retrieval": "FAIL", "source_folder": "FAIL", "local_set": "WARN", "node_differs": "WARN"}
    assert run(root, population, F.col("a") >= 0, "file.jsonl")["source_folder"] == "FAIL"


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(1, 1, True, False)] * 9 + [(0, 1, None, False)], {"visibility_recorded": "WARN", "unanchored_subset": "WARN", "distinct_from_suggestion": "WARN"}),
        ([(1, 1, False, False)] * 10, {"visibility_recorded": "PASS", "unanchored_subset": "PASS", "distinct_from_suggestion": "FAIL"}),
        ([(1, 1, True, False)] * 5 + [(2, 1, False, False)] * 10, {"visibility_recorded": "PASS", "unanchored_subset": "PASS", "distinct_from_suggestion": "PASS"}),
        ([(1, None, None, True)] * 3, {"free_of_anchoring": "PASS"}),
        ([(1, None, None, True), (1, None, None, None)], {"free_of_anchoring": "SKIP"}),
        ([(None, 1, True, False)], {"free_of_anchoring": "SKIP"}),
    ],
)
def test_anchoring(spark, rows, want):
    sheet = spark.createDataFrame(rows, "j int, s int, v boolean, w boolean")
    assert statuses(audit.anchoring(sheet, F.col("j"), F.col("s"), F.col("v"), F.col("w"))) == want
