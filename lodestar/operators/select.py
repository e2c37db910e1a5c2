"""Selections and set operations over candidate rows (DataFrame to DataFrame)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order


def split_valid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that pass and those that don't; a null test does not pass, so no row is in neither."""
    good = F.coalesce(valid, F.lit(False))
    return df.where(good), df.where(~good)


def blind(df: DataFrame, id_: str, shown: list[str]) -> tuple[DataFrame, DataFrame]:
    """A sheet with the allowed columns only, and the key with all others; both carry the id."""
    return df.select(id_, *shown), df.select(id_, *[c for c in df.columns if c != id_ and c not in shown])


def with_fallback(df: DataFrame, by: str, rank: str, kept: str, on_empty: str) -> DataFrame:
    """Where a question keeps nothing, its best candidate (`keep_top1`) or nothing (`no_evidence`), and which it was.

    Whether a question keeps anything comes by partial aggregation, so its rows are not gathered.
    """
    if on_empty not in ("keep_top1", "no_evidence"):
        raise ValueError(f"unknown on_empty {on_empty!r}; expected 'no_evidence' or 'keep_top1'")
    state = df.groupBy(F.col(by).alias("_by")).agg(F.max(F.col(kept).cast("int")).alias("_any"), F.min(rank).alias("_best"))
    rows = df.join(state, F.col(by) == F.col("_by"))
    empty = F.col("_any") == 0
    final = F.col(kept) | (empty & (F.col(rank) == F.col("_best"))) if on_empty == "keep_top1" else F.col(kept)
    return rows.withColumns({kept: final, "fallback": F.when(empty, on_empty)}).drop("_by", "_any", "_best")


def ordered_distinct(df: DataFrame, key: list[str], place: str) -> DataFrame:
    """Each key once, at its first place; partial aggregation, no window."""
    return df.groupBy(*key).agg(F.min(place).alias(place))


def union_of_layers(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of the first layer, then what the second has besides; layer 0 or 1."""
    extra = second.join(first.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
    return first.withColumn("layer", F.lit(0)).unionByName(extra.withColumn("layer", F.lit(1)))


def numbers_in(text: Column, *patterns: str) -> Column:
    """The numbers that the patterns capture, as a struct that sorts by value; null where there are none."""
    return F.struct(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("bigint").alias(f"n{i}") for i, p in enumerate(patterns)])


def extremes(df: DataFrame, tag: Column, score: Column, id_: str, n: int, highest: bool) -> DataFrame:
    """The n most extreme rows of each tag; groups are cut before the shuffle. Rows without a tag are in none."""
    rows = df.withColumns({"case": tag, "_score": score}).where("case is not null")
    order = F.desc("_score") if highest else F.asc("_score")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("case").orderBy(order, id_))).where(F.col("place") <= n)


def most_common(df: DataFrame, value: str, n: int | None = None) -> DataFrame:
    """Values by falling count, ties by value; `of` counts all values, even where only n are shown."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.count(F.lit(1)).alias("of"))
    shown = counts.orderBy(F.desc("n"), value)
    return (shown.limit(n) if n else shown).crossJoin(F.broadcast(total))


def aligned(left: DataFrame, right: DataFrame, id_: str) -> DataFrame:
    """The i-th id of each side by order of ids, joined on i; a position of one side only stays.

    Positions come from ranges between sampled splitters, so no task sorts a whole side, however sparse its ids are.
    """
    a = positions(left, id_).select(F.col("position"), F.col(id_).alias("left_id"))
    b = positions(right, id_).select(F.col("position"), F.col(id_).alias("right_id"))
    return a.join(b, "position", "full").withColumn("agree", F.col("left_id").eqNullSafe(F.col("right_id")))


def positions(df: DataFrame, id_: str) -> DataFrame:
    """0-based place of each row by its id; rows of one id follow one another."""
    counted = order.counts(df, id_, [])
    return counted.select(id_, F.explode(F.sequence(F.col("before"), F.col("before") + F.col("c") - 1)).alias("position"))


def same_sequence(df: DataFrame, by: str, id_: str, place_a: str, place_b: str) -> DataFrame:
    """Whether two orders of each group's ids are the same, by the places themselves; nothing is collected."""
    differs = ~F.col(place_a).eqNullSafe(F.col(place_b))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (F.count_if(differs) == 0).alias("same"))
