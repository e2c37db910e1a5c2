"""Corpus layers: chunks, content dedup, overlays, logs and provenance (DataFrame to DataFrame)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as X


def chunks(docs: DataFrame, size: int = 256, overlap: int = 32, least: int = 20) -> DataFrame:
    """Word windows of every document, with id, place, words and SHA-256; no shuffle."""
    words = F.split(X.squash(F.coalesce("text", F.lit(""))), " ")
    rows = docs.withColumn("_words", F.filter(words, lambda w: w != ""))
    starts = X.window_starts(F.col("_words"), size, overlap, least)
    cut = F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice("_words", s + 1, size).alias("p")))  # each window takes its own words along, not all
    pieces = F.transform(cut, lambda x: F.struct(x["s"].alias("window_start"), F.array_join(x["p"], " ").alias("text"), F.size(x["p"]).cast("long").alias("word_count")))
    rows = rows.select(*[c for c in docs.columns if c != "text"], F.posexplode(pieces).alias("chunk_index", "_piece"))
    rows = rows.withColumns({"window_start": F.col("_piece.window_start"), "text": F.col("_piece.text"), "word_count": F.col("_piece.word_count")}).drop("_piece")
    rows = rows.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("#body.w"), F.col("chunk_index").cast("string")))
    return rows.withColumn("text_sha256", F.sha2("text", 256))


def flag_duplicates(df: DataFrame, key: str, id_: str, *order: str) -> DataFrame:
    """duplicate_of is blank on the first row of each key, and that row's id on the others.

    The first row is found by partial aggregation and met again by the key, so a
    content that very many rows share is not sorted in one task.
    """
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.col(id_), F.struct(*order)).alias("_first"))
    joined = df.join(first, F.col(key) == F.col("_key"))
    return joined.withColumn("duplicate_of", F.when(F.col(id_) == F.col("_first"), "").otherwise(F.col("_first"))).drop("_key", "_first")


def last_wins(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by partial aggregation."""
    rest = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, "_row.*")


def first_by(value: Column, order: Column) -> Column:
    """The earliest value that is not blank."""
    good = F.nullif(F.trim(value), F.lit(""))
    return F.min_by(good, F.when(good.isNotNull(), order))


def lookup(df: DataFrame, dim: DataFrame, on: Column, fields: dict[str, Column]) -> DataFrame:
    """A left lookup whose fields default to blank; the planner broadcasts a small dimension."""
    return df.join(dim, on, "left").select(*df.columns, *[F.coalesce(v, F.lit("")).alias(k) for k, v in fields.items()])


def composite_key(first: Column, second: Column, prefix: str) -> Column:
    """The first id unless it is blank, else the prefixed second one."""
    return F.coalesce(F.nullif(F.trim(first), F.lit("")), F.concat(F.lit(prefix), F.trim(second)))


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side with flags of where they are."""
    a = left.select(*keys).distinct().withColumn("in_left", F.lit(True))
    b = right.select(*keys).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, keys, "full").fillna(False, ["in_left", "in_right"])


def ordered_digest(df: DataFrame, group: list[str], key: str, value: str, block: int = 4096) -> DataFrame:
    """SHA-256 over a group's `key NUL value` pairs in order of a whole-number key, in two steps.

    Pairs of each `block` consecutive keys have a digest of their own, and the group's is over those in order: a task
    holds one block of pairs, and of a group one digest for each block.
    """
    def over(parts, lines):
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lines), "\x00"), 256)

    rows = df.withColumn("_block", F.floor(F.col(key) / block))
    pairs = over(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), lambda p: F.concat_ws("\x00", p["k"].cast("string"), p["v"].cast("string")))
    blocks = rows.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"), pairs.alias("_d"))
    return blocks.groupBy(*group).agg(F.sum("_n").alias("n"), over(F.struct("_block", "_d"), lambda p: p["_d"]).alias("digest"))


def running_offsets(sizes: DataFrame, group: list[str], order: str, size: str) -> DataFrame:
    """The sum of the sizes before each row of its group."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))
