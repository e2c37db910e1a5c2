"""Statistics: ranks, correlations, exact tests, bootstrap and step-down control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.stored import write_once

from . import order


def average_ranks(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Df with the mean rank of each row's tie group; null for a null value."""
    ranks = order.counts(df, value, by).select(*[F.col(x).alias(f"_g{i}") for i, x in enumerate(by)], F.col(value).alias("_v"), (F.col("before") + (F.col("c") + 1) / F.lit(2.0)).alias(name))
    return df.join(ranks, [F.col(value) == F.col("_v"), *[F.col(x).eqNullSafe(F.col(f"_g{i}")) for i, x in enumerate(by)]], "left").drop("_v", *[f"_g{i}" for i in range(len(by))])


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson over average ranks; null under three pairs or without variance.

    Rows are counted by (x, y) first. Both columns' values are ranked in one pass, as two axes of one table, and the
    sums are taken over the different pairs.
    """
    pairs = write_once(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_n")), "pairs")
    values = pairs.select(*by, F.col("_n"), F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col("_x").alias("v")), F.struct(F.lit(1).alias("axis"), F.col("_y").alias("v")))).alias("a"))
    counted = values.groupBy(*by, F.col("a.axis").alias("_axis"), F.col("a.v").alias("_v")).agg(F.sum("_n").alias("c"))
    ranks = write_once(order.running(counted, [*by, "_axis"], ["_v"], F.col("c")).withColumn("_rank", F.col("before") + (F.col("c") + 1) / F.lit(2.0)), "ranks")
    for axis, (column, name) in enumerate((("_x", "_rx"), ("_y", "_ry"))):
        own = ranks.where(F.col("_axis") == axis).select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], F.col("_v"), F.col("_rank").alias(name))
        pairs = pairs.join(own, [F.col(column) == F.col("_v"), *[F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)]]).drop("_v", *[f"_g{i}" for i in range(len(by))])
    n, a, b = F.sum("_n"), F.col("_rx"), F.col("_ry")
    s = lambda e: F.sum(F.col("_n") * e)
    va, vb, cov = s(a * a) - s(a) * s(a) / n, s(b * b) - s(b) * s(b) / n, s(a * b) - s(a) * s(b) / n
    varied = (F.min("_rx") < F.max("_rx")) & (F.min("_ry") < F.max("_ry"))
    sums = pairs.groupBy(*by).agg(n.alias("n"), va.alias("_va"), vb.alias("_vb"), cov.alias("_cov"), varied.alias("_varied"))
    good = (F.col("n") >= 3) & F.col("_varied")
    return sums.select(*by, "n", F.when(good, F.round(F.try_divide(F.col("_cov"), F.sqrt(F.col("_va") * F.col("_vb"))), 9)).alias("rho"))


def quantile(df: DataFrame, value: str, q: float, by: list[str], name: str) -> DataFrame:
    """By and the value at q, linear between its neighbours, from counts; no rows, no quantile."""
    counts = order.counts(df, value, by)
    last = counts.groupBy(*by).agg((F.sum("c") - 1).alias("_last"))
    rows = counts.alias("x").join(last.alias("l"), [F.col(f"x.{b}").eqNullSafe(F.col(f"l.{b}")) for b in by]) if by else counts.alias("x").crossJoin(F.broadcast(last.alias("l")))
    at = F.col("_last") * F.lit(q)
    low, high = F.floor(at), F.ceil(at)
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("c"))
    v = F.col(f"x.{value}").cast("double")
    ends = rows.groupBy(*[F.col(f"x.{b}").alias(b) for b in by]).agg(F.max(F.when(holds(low), v)).alias("_a"), F.max(F.when(holds(high), v)).alias("_b"), F.max(at - low).alias("_d"))
    return ends.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_d")).alias(name))


def tertile_edges(df: DataFrame, value: str) -> DataFrame:
    """The sorted values at n div 3 and 2n div 3, from counts of values."""
    counts = order.counts(df, value, [])
    total = counts.agg(F.sum("c").alias("n"))
    edge = lambda k: F.min(F.when(F.col("before") + F.col("c") > F.floor(k * F.col("n") / 3), F.col(value)))
    return counts.crossJoin(F.broadcast(total)).agg(edge(1).alias("edge_low"), edge(2).alias("edge_high"))


def bin_of(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, "low").when(value < high, "medium").otherwise("high")


def cohens_h(p1: Column, p2: Column) -> tuple[Column, Column]:
    """Effect size of two rates, to 9 places, and its magnitude."""
    h = F.round(2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2)), 9)
    a = F.abs(h)
    return h, F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact p of k of n at one half: the sum of the outcomes no likelier than the observed one.

    At one half these are both tails from the nearer end, and they are the same. Terms shrink outwards; those more
    than 10 sqrt(n) + 100 places out are below a double's last digit, so the list has no more terms than that.
    """
    log_p = lambda i: log_factorial(n) - log_factorial(i) - log_factorial(n - i) - n * F.ln(F.lit(2.0))
    near = F.least(k, n - k)
    terms = F.least(near, (F.lit(10.0) * F.sqrt(n.cast("double")) + 100).cast("long"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), terms), F.lit(0.0), lambda s, j: s + F.exp(log_p(near - j)))
    return F.when(n > 0, F.round(F.least(F.lit(1.0), 2 * tail), 9)).otherwise(F.lit(1.0))


def log_factorial(n: Column) -> Column:
    """Stirling's series for n above 8, to double precision there; exact below."""
    x = (n + 1).cast("double")
    shifted = x + 8  # ln G(x) = ln G(x + 8) - ln x(x+1)...(x+7)
    series = (shifted - 0.5) * F.ln(shifted) - shifted + F.lit(0.9189385332046727) + 1 / (12 * shifted) - 1 / (360 * F.pow(shifted, F.lit(3.0))) + 1 / (1260 * F.pow(shifted, F.lit(5.0)))
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return series - F.ln(product)


def holm(tests: DataFrame, p: str, alpha: float, *, id_: str) -> DataFrame:
    """Step-down: a test is rejected if it and all before it, by p, pass their thresholds. For a family of tests (a report's size)."""
    by_p = Window.orderBy(p, id_)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = tests.withColumn("rank", F.row_number().over(by_p)).withColumn("threshold", F.lit(alpha) / (m - F.col("rank") + 1))
    failed = F.max((F.col(p) > F.col("threshold")).cast("int")).over(by_p.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("rejected", failed == 0)


def cluster_sums(df: DataFrame, cluster: str, value: Column) -> DataFrame:
    """Sums and counts of each cluster: all that a rate or mean needs from it."""
    return df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))


def overlap(a: Column, b: Column) -> dict[str, Column]:
    """Sizes and Jaccard of two id arrays; null if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return {"both": both.cast("long"), "only_a": F.size(F.array_except(a, b)).cast("long"), "only_b": F.size(F.array_except(b, a)).cast("long"), "jaccard": F.try_divide(both.cast("double"), either.cast("double"))}
