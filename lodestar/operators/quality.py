"""Quality suites: each check is a row (check, pass, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass over the rows counts the violations of every rule."""
    counts = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "check", "n").select("check", (F.col("n") == 0).alias("pass"), F.col("n").cast("string").alias("detail"))


def unique_key(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows beyond the first of each key; counted by key, so no task gathers a key's rows."""
    extra = df.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return extra.select(F.lit(name).alias("check"), (F.col("n") == 0).alias("pass"), F.col("n").cast("string").alias("detail"))


def no_orphans(df: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    n = df.join(parent.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit(name).alias("check"), (F.col("n") == 0).alias("pass"), F.col("n").cast("string").alias("detail"))


def reproduction(rebuilt: DataFrame, recorded: DataFrame, keys: list[str], value: str, tolerance: float, name: str) -> DataFrame:
    """Q11: the largest difference between rebuilt and recorded values, and keys of one side only."""
    a = rebuilt.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ina"))
    b = recorded.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_inb"))
    found = a.join(b, keys, "full").agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("most"), F.count_if(F.col("_ina").isNull() | F.col("_inb").isNull()).alias("alone"))
    good = (F.coalesce("most", F.lit(0.0)) <= tolerance) & (F.col("alone") == 0)
    return found.select(F.lit(name).alias("check"), good.alias("pass"), F.concat_ws(" ", F.coalesce("most", F.lit(0.0)).cast("string"), F.col("alone").cast("string")).alias("detail"))


def gate(checks: DataFrame) -> DataFrame:
    """Q13: whether all checks pass, and which block; a suite has a few rows."""
    blocking = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("pass"), F.col("check")))), ";")
    return checks.agg(F.bool_and("pass").alias("reportable"), blocking.alias("blocking"))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """Shortest, and the value at n div 2 of the sorted ones, by counts of the distinct values."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("_total"))
    # distinct lengths are few; their running count is one small window
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return upto.crossJoin(F.broadcast(total)).agg(F.min(value).alias("shortest"), F.min(F.when(F.col("upto") > F.floor(F.col("_total") / 2), F.col(value))).alias("upper_median"))
