"""The numpy kernels of resamples against hashlib and the column expressions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import draws as D
from lodestar.operators import resample as R


def part(text, i):
    return int(hashlib.md5(text.encode()).hexdigest()[7 * i : 7 * i + 7], 16)


@pytest.mark.parametrize("grid", [1, 7, 16384])
def test_every_pair_is_hashed_once(monkeypatch, grid):
    monkeypatch.setattr(D, "GRID", grid)
    ids = ["0", "7", "-3", "12:5", "1234567", "é", "x" * 43, "x" * 44, "x" * 52, "y" * 130]
    got = [(int(b), int(p), [int(u[i, j]) for u in parts]) for bs, ps, parts in D.uniforms(20260910, ids, 45) for i, b in enumerate(bs) for j, p in enumerate(ps)]
    want = [(b, p, [part(f"20260910:{b}:{x}", k) for k in range(4)]) for b in range(12) for p, x in enumerate(ids)]
    assert sorted(got) == sorted(want)


def test_counts_equal_the_column_expressions(spark):
    u = np.array([[0, 98756258, 98756259, 197509000, 250000000, 263338000, 268000000, 2**28 - 1]], np.uint32)
    rows = [(int(v), m) for v in u[0] for m in (1, 2, 7, 300, 5000)]
    column = F.when(F.col("m") == 1, R.weight(F.col("v") / 2**28)).otherwise(R.reached(R.steps(F.col("m")), F.col("v") / 2**28))
    want = {(r["v"], r["m"]): r["w"] for r in spark.createDataFrame(rows, "v long, m long").select("v", "m", column.alias("w")).collect()}
    for m in (1, 2, 7, 300, 5000):
        assert [want[int(v), m] for v in u[0]] == D.often(u, np.full(u.shape[1], m), {})[0].tolist()


def test_no_row_of_a_unit_and_a_block_is_made(spark):
    units = spark.createDataFrame([(i, float(i)) for i in range(9)] + [(None, 1.0)], "id long, v double")
    plan = R.totals(units, "id", {"v": F.col("v")}, 10000, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_units_without_id_are_in_no_draw(spark):
    rows = [(i, float(i)) for i in range(9)]
    total = lambda r: {x["draw"]: x["v"] for x in R.totals(spark.createDataFrame(r, "id long, v double"), "id", {"v": F.col("v")}, 12, 5).collect()}
    assert total(rows) == total([*rows, (None, 100.0)])


def test_differences_drawn_together_equal_each_alone(spark):
    pairs = spark.createDataFrame([(i, i / 7, None if i % 3 == 0 else -i / 5) for i in range(40)], "id long, a double, b double")
    together = [r.first() for r in R.paired_bootstraps(pairs, "id", ["a", "b"], 200, 4)]
    assert together == [R.paired_bootstrap(pairs, "id", d, 200, 4).first() for d in ("a", "b")]


@pytest.mark.parametrize("flipped", [False, True])
def test_ranges_and_rows_give_the_same_correlations(spark, monkeypatch, flipped):
    monkeypatch.setattr(D, "GRID", 64)
    frame = spark.createDataFrame([(float(i * 37 % 211) if i % 5 else 3.0, i * i % 4) for i in range(400)], "x double, y int")
    x, y = ("y", "x") if flipped else ("x", "y")
    by_range = R.bootstrap_spearman(frame, x, y, 40, 3).first()
    monkeypatch.setattr(R, "_sums_by_range", None)
    monkeypatch.setattr(R, "FEW", 0)
    assert by_range == R.bootstrap_spearman(frame, x, y, 40, 3).first()
