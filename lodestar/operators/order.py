"""Exact order of large tables: ranges between sampled splitters, sums over ranges, places inside them.

Spark draws the splitters of a range partitioning from a sample of the rows
themselves, so a range holds its share of them however the values lie (outliers,
lognormal values, hashed ids, few or many groups): there is no width of a bucket
to choose. The ranges are written down once with their numbers, because two
passes read them. The sums over ranges are as many rows as there are ranges, and
groups in them; only one range of a group is put in order by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.stored import write_once

RANGE = "_range"


def ranges(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """df with the number of its range by the order's columns, stored; parts: the session's shuffle partitions by default.

    Rows that are equal in all the columns share a range: count them first if there may be many.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write_once(df.repartitionByRange(parts, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def running(df: DataFrame, by: list[str], order: list[str], weight: Column | None = None, name: str = "before", parts: int | None = None) -> DataFrame:
    """df with the sum of the weights (default: the number) of the rows before each in its group; null groups are groups.

    order within a group should be total: of equal rows any may come first.
    """
    rows = ranges(df.withColumn("_w", F.lit(1).cast("long") if weight is None else weight), [*by, *order], parts)
    sums = rows.groupBy(*by, RANGE).agg(F.sum("_w").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], F.col(RANGE).alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    met = placed.join(starts, [F.col(RANGE) == F.col("_r"), *[F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)]])
    return met.select(*df.columns, (F.col("_start") + F.col("_inside")).alias(name))


def counts(df: DataFrame, value: str, by: list[str], parts: int | None = None) -> DataFrame:
    """by, value, c and before: how many rows of the group have the value and how many a smaller one; nulls are left out."""
    return running(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c")), by, [value], F.col("c"), parts=parts)


def places(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """df with each row's 0-based place in the whole table, by a total order."""
    return running(df, [], order, name=name)
