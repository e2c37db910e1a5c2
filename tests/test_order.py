"""Exact ranks, quantiles and places on values that equal widths can't split."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import label, order, select, stats


def skewed(n, seed=1):
    rng = random.Random(seed)
    return [rng.lognormvariate(0, 4) for _ in range(n)] + [1e12, -1e12, 1e300, 0.0]


def test_ranges_hold_their_share_of_skewed_values(spark):
    values = spark.createDataFrame([(v,) for v in skewed(20_000)], "v double")
    sizes = [r["n"] for r in order.ranges(values, ["v"], 16).groupBy(order.RANGE).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / 16
    spans = order.ranges(values, ["v"], 16).groupBy(order.RANGE).agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy(order.RANGE).collect()
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_counts_before_each_value(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([*skewed(40), 5.0, 5.0, 5.0, None])) for _ in range(900)]
    got = order.counts(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], parts).collect()
    want = set()
    for g, v in {r for r in rows if r[1] is not None}:
        own = [x for h, x in rows if h == g and x is not None]
        want.add((g, v, own.count(v), sum(x < v for x in own)))
    assert set(map(tuple, got)) == want and len(got) == len(want)


def test_quantiles_and_edges_of_skewed_values(spark):
    values = sorted(skewed(5000, 3))
    df = spark.createDataFrame([(v,) for v in random.Random(4).sample(values, len(values))], "v double")
    at = 0.75 * (len(values) - 1)
    want = values[int(at)] + (values[int(at) + 1] - values[int(at)]) * (at - int(at))
    assert stats.quantile(df, "v", 0.75, [], "q").first()["q"] == pytest.approx(want, rel=1e-12)
    edges = stats.tertile_edges(df, "v").first()
    assert (edges["edge_low"], edges["edge_high"]) == (values[len(values) // 3], values[2 * len(values) // 3])


def test_spearman_of_ties_and_groups_without_variance(spark):
    rng = random.Random(6)
    rows = [("a", rng.randrange(5), rng.lognormvariate(0, 3)) for _ in range(300)] + [("b", 1, float(i)) for i in range(5)] + [("c", 1, 1.0), ("c", 2, 2.0), ("d", None, 1.0)]
    got = {r["g"]: (r["n"], r["rho"]) for r in stats.spearman(spark.createDataFrame(rows, "g string, x int, y double"), "x", "y", ["g"]).collect()}

    def ranks(values):
        return [sum(b < a for b in values) + (values.count(a) + 1) / 2 for a in values]

    x, y = ranks([r[1] for r in rows if r[0] == "a"]), ranks([r[2] for r in rows if r[0] == "a"])
    m = (len(x) + 1) / 2
    rho = sum((a - m) * (b - m) for a, b in zip(x, y, strict=True)) / (sum((a - m) ** 2 for a in x) * sum((b - m) ** 2 for b in y)) ** 0.5
    assert got["a"][1] == pytest.approx(rho, abs=1e-8) and got["b"] == (5, None) and got["c"] == (2, None) and "d" not in got


def test_places_of_sparse_and_repeated_ids(spark):
    rng = random.Random(7)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)] + [5, 5, 5]
    got = sorted((r["position"], r["id"]) for r in select.positions(spark.createDataFrame([(i,) for i in ids], "id long"), "id").collect())
    assert got == list(enumerate(sorted(ids)))


def test_forced_rows_are_placed_without_one_window(spark):
    rows = [(i, f"c{i % 7}", i % 3 == 0) for i in range(500)]
    out = label.round_robin(spark.createDataFrame(rows, "id long, cell string, f boolean"), "cell", "id", F.col("f"), 200, 7).collect()
    forced = [r for r in out if r["forced"]]
    assert len(forced) == 167 and len(out) == 200 and sorted(r["place"] for r in out) == list(range(1, 201))
    assert [r["id"] for r in sorted(forced, key=lambda r: r["place"])] == [i for i, c, f in sorted(rows, key=lambda r: (r[1], r[0])) if f]
    assert len({r["cell"] for r in out if not r["forced"]}) == 7


@pytest.mark.parametrize("rows", [[], [(None,)]])
def test_nothing_to_order(spark, rows):
    df = spark.createDataFrame(rows, "v double")
    assert order.counts(df, "v", []).count() == 0 and stats.quantile(df, "v", 0.5, [], "q").where("q is not null").count() == 0
