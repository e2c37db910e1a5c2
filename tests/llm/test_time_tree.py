"""The time tree against loops over all intervals, and the feature table against its rule."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.llm import time_tree as T

BASE = 1_704_067_200_000_000


def stab_by_force(intervals, probes, windows):
    out = {}
    for key, t in {p for p in probes if None not in p}:
        for k, w, lo, hi, v, m in intervals:
            if k == key and lo is not None and hi is not None and lo <= t < hi:
                row = out.setdefault((key, t), {})
                row[f"v_{w}"] = row.get(f"v_{w}", 0) + v
                if m is not None:
                    row[f"m_{w}"] = max(row.get(f"m_{w}", m), m)
    return {k: tuple(r.get(f"{c}_{w}") for w in windows for c in "vm") for k, r in out.items()}


def times(rng, kind):
    """Times in whole seconds, in single microseconds, in one burst, before 1970, or at the edges of blocks."""
    if kind == "seconds":
        return BASE + rng.randrange(10_000_000) * 1_000_000
    if kind == "micros":
        return BASE + rng.randrange(3_000_000)
    if kind == "burst":
        return BASE + rng.choice([0, 1, 2, 3, 64, 65, 4096, 1 << 30])
    if kind == "before":
        return rng.randrange(-(1 << 43), 1 << 43)
    return rng.choice([-1, 0, 1]) + (rng.randrange(60) << rng.choice([6, 12, 18, 36, 42]))


@pytest.mark.parametrize("kind", ["seconds", "micros", "burst", "before", "edges"])
def test_sums_over_intervals(spark, kind):
    rng = random.Random(kind)
    key = lambda: rng.choice([1, 1, 1, 2, 3, 4, None])
    probes = [(key(), times(rng, kind)) for _ in range(150)] + [(5, None), (6, 7)]
    intervals = []
    for _ in range(200):
        a, b = times(rng, kind), times(rng, kind)
        intervals.append((key(), rng.choice([2, 14]), min(a, b), max(a, b), rng.randrange(5), rng.choice([None, rng.randrange(99)])))
    intervals += [(1, 2, None, 5, 1, 1), (1, 2, 9, 9, 1, 1), (1, 2, probes[0][1], probes[0][1] + 1, 7, 7)]
    frame = spark.createDataFrame(intervals, "key long, w int, lo long, hi long, v long, m long")
    got = T.stab(frame, spark.createDataFrame(probes, "key long, t long"), [2, 14], ["v"], ["m"]).collect()
    assert {(r["key"], r["t"]): (r["v_2"], r["m_2"], r["v_14"], r["m_14"]) for r in got} == stab_by_force(intervals, probes, [2, 14])


def shop(seed):
    rng = random.Random(seed)
    day = lambda most: datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(most * 86_400), microseconds=rng.choice([0, 0, 250_001]))
    maybe = lambda x, p=0.05: None if rng.random() < p else x
    late = lambda t: t + timedelta(seconds=rng.choice([0, 30, 5_000, 200_000, 2_000_000]))
    sales, lines, clicks = [], [], []
    for i in range(160):
        t = day(40)
        sales.append((maybe(i), maybe(rng.choice([1, 1, 1, 2, 3])), maybe(rng.choice([1.005, 2.5, float("nan"), float("inf"), -0.3])), maybe(t), maybe(late(t))))
        for _ in range(rng.randrange(4)):
            lines.append((maybe(i), maybe(rng.choice([7, 7, 8, 9])), maybe(rng.choice([1.5, 2.25])), maybe(t + timedelta(days=rng.randrange(-2, 12)))))
    sales += sales[:5]
    lines += [(3, 7, 1.0, datetime(2024, 1, 5))] * 30
    for i in range(300):
        t = day(40)
        clicks += [(maybe(i), maybe(t), maybe(late(t)), maybe(rng.choice([1, 1, 2, 3])), maybe(rng.choice(["purchase", "view"])), maybe(3.335), "x")] * rng.choice([1, 1, 2])
    t = datetime(2024, 1, 20)
    clicks += [(i, t, t, 1, "view", 1.0, "x") for i in (900, 950, None, -4)]
    return sales, clicks, lines


SALES, CLICKS, LINES = "sale_id long, client_id long, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz", "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string", "sale_id long, item_id long, amount double, shipped_at timestamp_ntz"


def features_by_force(sales, clicks, lines, at):
    us = lambda t: None if t is None else (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    cents = lambda x: 0 if x is None or x != x or abs(x) > 9e15 else int((x * 100 + 0.5) // 1)
    known = [(i, c, cents(x), us(s), None if a is None else us(a) + T.LATE_MINUTES * T.MINUTE) for i, c, x, s, a in sales if c is not None and s is not None]
    out = []
    for i, c, _, s, _ in known:
        t = at(i, s)
        label = any(c2 == c and t < s2 <= t + T.HORIZON * T.DAY for _, c2, _, s2, _ in known)
        for d in T.WINDOWS:
            k = [x for x in set(clicks) if x[3] == c and None not in (x[1], x[2]) and t - d * T.DAY < us(x[1]) <= t and us(x[2]) + T.LATE_MINUTES * T.MINUTE <= t]
            mine = [x for x in known if x[1] == c and x[4] is not None and t - d * T.DAY < x[3] <= t and x[4] <= t]
            ls = [y for x in mine for y in lines if y[0] is not None and y[0] == x[0] and y[3] is not None and us(y[3]) <= t]
            last = max(((x[1], x[0] is not None, x[0]) for x in k), default=(0, 0, None))[2]
            out.append((i, d, t, label, len(k), sum(x[4] == "purchase" for x in k), sum(cents(x[5]) for x in k), last, len(mine), sum(x[2] for x in mine), len(ls), len({y[1] for y in ls} - {None}), sum(cents(y[2]) for y in ls)))
    return out


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_features_equal_their_rule(spark, zone):
    rows = shop(zone)
    frames = [spark.createDataFrame(r, schema) for r, schema in zip(rows, (SALES, CLICKS, LINES), strict=True)]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = T.point_in_time(*frames, F.col("sold") + F.coalesce(F.col("sale_id"), F.lit(0)) % 5 * 40_000_000_001).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = features_by_force(*rows, lambda i, s: s + (i or 0) % 5 * 40_000_000_001)
    assert Counter(map(tuple, got)) == Counter(want)


def test_extra_columns_and_empty_tables(spark):
    sales, clicks, lines = (spark.createDataFrame(r, schema) for r, schema in zip(shop(5), (SALES, CLICKS, LINES), strict=True))
    odd = lambda df: df.withColumns({c: F.lit("x") for c in ("key", "t", "sold_", "w", "node", "block", "n_clicks")})
    plain = T.point_in_time(sales, clicks, lines, F.col("sold")).collect()
    assert Counter(map(tuple, T.point_in_time(odd(sales), odd(clicks), odd(lines), F.col("sold")).collect())) == Counter(map(tuple, plain))
    assert T.point_in_time(sales.limit(0), clicks, lines, F.col("sold")).count() == 0
    alone = T.point_in_time(sales, clicks.limit(0), lines.limit(0), F.col("sold")).collect()
    assert len(alone) == len(plain) and {(r["n_clicks"], r["last_click_id"], r["n_lines"]) for r in alone} == {(0, None, 0)}
