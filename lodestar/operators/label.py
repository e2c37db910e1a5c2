"""Labels and samples: hash-ordered draws, negatives, splits, and state over annotation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order


def draw_key(seed: int, *cols: str) -> Column:
    """A hash order that any engine can repeat: md5 of seed and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def per_stratum(df: DataFrame, strata: list[str], id_: str, n: int, seed: int) -> DataFrame:
    """N rows of each stratum in hash order; groups are cut before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(draw_key(seed, id_), id_))
    return df.withColumn("draw", rank).where(F.col("draw") <= n)


def round_robin(df: DataFrame, cell: str, id_: str, forced: Column, size: int, seed: int) -> DataFrame:
    """All forced rows, then one row of each cell in turn until the size is reached.

    Forced rows, of which there may be any number, get their places from ranges of (cell, id). Of the rest only the
    first `size` rows of each cell can be drawn, and the first `size` of those in turn are taken by one sorted limit.
    """
    must = order.places(df.where(forced), [cell, id_], "_at").withColumns({"draw": F.lit(0), "forced": F.lit(True), "place": F.col("_at") + 1})
    total = must.agg(F.count(F.lit(1)).alias("_must"))
    rest = per_stratum(df.where(~forced), [cell], id_, size, seed).orderBy("draw", cell, id_).limit(size)
    turn = rest.withColumn("_at", F.row_number().over(Window.orderBy("draw", cell, id_))).crossJoin(F.broadcast(total))
    drawn = turn.withColumns({"forced": F.lit(False), "place": F.col("_must") + F.col("_at")}).where(F.col("place") <= size)
    names = [*df.columns, "draw", "forced", "place"]
    return must.select(*names).union(drawn.select(*names))


def easy_negatives(questions: DataFrame, corpus: DataFrame, matches: DataFrame, qid: str, did: str, n: int, seed: int, pool: int) -> DataFrame:
    """Hash-drawn documents without any match with the question, from a pool that the seed fixes.

    The pool is the first `pool` documents in hash order, whatever the corpus' size, so no question meets all documents.
    """
    drawn = corpus.select(did).orderBy(draw_key(seed, did), did).limit(pool)
    pairs = questions.select(qid).crossJoin(F.broadcast(drawn)).join(matches.select(qid, did), [qid, did], "left_anti")
    rank = F.row_number().over(Window.partitionBy(qid).orderBy(draw_key(seed, qid, did), did))
    return pairs.withColumn("draw", rank).where(F.col("draw") <= n)


def longest_valid_prefix(df: DataFrame, group: str, order: str, valid: Column) -> DataFrame:
    """Rows before the first bad one of their group."""
    first_bad = df.groupBy(F.col(group).alias("_g")).agg(F.min(F.when(~valid, F.col(order))).alias("_bad"))
    return df.join(first_bad, F.col(group) == F.col("_g")).where(F.col("_bad").isNull() | (F.col(order) < F.col("_bad"))).drop("_g", "_bad")


def next_unlabelled(df: DataFrame, group: str, order: str, label: str, after: int) -> DataFrame:
    """The first unlabelled row after a place, else the first of all."""
    free = F.col(label).isNull()
    return df.groupBy(group).agg(F.coalesce(F.min(F.when(free & (F.col(order) > after), F.col(order))), F.min(F.when(free, F.col(order)))).alias("next"), F.count_if(~free).alias("done"), F.count(F.lit(1)).alias("total"))


def permute_sides(older: Column, newer: Column, key: Column) -> tuple[Column, Column]:
    """A side flip per pair by a bit of its hash."""
    flip = F.substring(key, 1, 1).isin(*"01234567")
    return F.when(flip, newer).otherwise(older), F.when(flip, older).otherwise(newer)
