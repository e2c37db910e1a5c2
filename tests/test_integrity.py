"""Each kind of mismatch is planted and found, and shards merge in any order."""

import itertools

from pyspark.sql import functions as F

from lodestar.operators import integrity, retrieve


def test_planted_mismatches_are_rows(spark):
    chunks = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (2, "b", 5), (3, "a", 1), (4, "c", 9), (4, "d", 9), (None, "a", 1)] + [(6, "e", 1)] * 500, "doc long, source string, day int")
    policy = spark.createDataFrame([(1, "a", True), (2, "x", True), (3, "a", False), (4, "c", True), (5, "a", True), (6, "e", True), (6, "e", True)], "id long, source string, allowed boolean")
    dates = spark.createDataFrame([(1, 5), (2, 5), (3, 2), (4, 9), (6, 1)], "id long, day int")
    tables = {"c": (chunks, "doc", {"source": F.col("source"), "day": F.col("day")}), "p": (policy, "id", {"source": F.col("source"), "allowed": F.col("allowed")}), "d": (dates, "id", {"day": F.col("day")})}
    c, p = F.col("c_n") > 0, F.col("p_n") > 0
    rules = {
        "orphan": c & ~p, "leak": c & ~F.col("p_allowed_min"), "repeat": F.col("p_n") > 1, "conflict": F.col("c_source_min") != F.col("c_source_max"),
        "source": F.col("c_source_min") != F.col("p_source_min"), "date": F.col("c_day_min") < F.col("d_day_min"), "unused": p & ~c,
    }
    got = sorted(map(tuple, integrity.mismatches(tables, rules).collect()), key=str)
    assert got == sorted([(None, "orphan"), (2, "source"), (3, "leak"), (3, "date"), (4, "conflict"), (5, "unused"), (6, "repeat")], key=str)
    assert integrity.summary(tables).where("key = 6").first()["c_n"] == 500


def test_shards_merge_in_any_order(spark):
    rows = spark.createDataFrame([(q, i, float(i * 7 % 5)) for q in range(3) for i in range(40)], "q long, id long, score double")
    want = sorted(map(tuple, retrieve.top(rows, ["q"], [F.desc("score"), F.col("id")], 4).collect()))
    heads = [retrieve.top(rows.where(F.col("id") % 3 == s), ["q"], [F.desc("score"), F.col("id")], 4) for s in range(3)]
    for order in itertools.islice(itertools.permutations(heads), 3):
        assert sorted(map(tuple, retrieve.merge_shards(list(order), ["q"], 4).collect())) == want
    nested = retrieve.merge_shards([retrieve.merge_shards(heads[:2], ["q"], 4), heads[2]], ["q"], 4)
    assert sorted(map(tuple, nested.collect())) == want


def test_an_arm_that_always_fails_has_zeros(spark):
    from lodestar.operators import compare

    rows = [("a", 1, True, 5, None), ("a", 1, False, 9, None), ("a", 2, True, 3, "broken"), ("a", 3, False, 1, None), ("b", 1, True, 5, "broken")]
    got = {r["arm"]: tuple(r)[1:] for r in compare.arm_summary(spark.createDataFrame(rows, "arm string, q long, k boolean, c long, e string"), "arm", "q", "k", "c", "e").collect()}
    assert got == {"a": (3, 2, 1, 1.5, 0.5, 1, 3, 0.333333, 1, 2.5), "b": (1, 0, 1, 0.0, 0.0, 0, 0, 0.0, 0, 0.0)}
