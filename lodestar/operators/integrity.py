"""Tables that should agree on a key, held against each other in one pass instead of a chain of joins.

Each table's rows become tagged rows of one union, and one aggregation by key,
combined before the shuffle, keeps for every table how many rows it has and the
smallest and largest value of its fields. That is all that rules about orphans,
leaks, repeats, conflicts and mismatches need, so a hot key costs no more than
another, and every broken rule of a key is a row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(tables: dict[str, tuple[DataFrame, str, dict[str, Column]]]) -> DataFrame:
    """key, and for each table name_n (0: not there), name_field_min and name_field_max; a null key is a key.

    tables: name to the frame, its key column and its named fields.
    """
    parts, aggregates = [], []
    for name, (df, key, fields) in tables.items():
        parts.append(df.select(F.col(key).alias("key"), F.lit(1).cast("long").alias(f"{name}_n"), *[c.alias(f"{name}_{f}") for f, c in fields.items()]))
        aggregates.append(F.coalesce(F.sum(f"{name}_n"), F.lit(0)).alias(f"{name}_n"))
        for f in fields:
            aggregates += [F.min(f"{name}_{f}").alias(f"{name}_{f}_min"), F.max(f"{name}_{f}").alias(f"{name}_{f}_max")]
    together = functools.reduce(functools.partial(DataFrame.unionByName, allowMissingColumns=True), parts)
    return together.groupBy("key").agg(*aggregates)


def mismatches(tables: dict[str, tuple[DataFrame, str, dict[str, Column]]], rules: dict[str, Column]) -> DataFrame:
    """key and kind: a row for each rule (a test over the summary's columns) that a key breaks; a null test is no break."""
    broken = F.filter(F.array(*[F.when(test, F.lit(kind)) for kind, test in rules.items()]), lambda k: k.isNotNull())
    return summary(tables).select("key", F.explode(broken).alias("kind"))
