"""BM25 over stored postings with impacts, term maxima and block maxima, and exact top-k without scoring every pair.

An impact is what a posting adds to a score. A first guess scores a few of
the documents with the highest impacts of each term; the k-th best of them
bounds the answer from below. A question's terms with the smallest maxima that together stay under
that bound can't lift a document into the answer on their own, so candidates
come from the postings of the other terms only. A candidate stays if its part so
far and the maxima of its block for the terms left out can reach the bound;
those that stay are scored in full. Nothing that could be in the answer is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.stored import write_once

from . import retrieve

#: Documents of a block, a margin above the rounding of scores (9 places), and how many times k documents the first guess scores.
BLOCK, MARGIN, GUESSES = 8, 1e-8, 5


@dataclass
class Index:
    """postings (term, doc, block, impact) by falling impact within a term; terms (term, df, top); blocks (term, block, top)."""

    postings: DataFrame
    terms: DataFrame
    blocks: DataFrame
    stats: DataFrame


def build(docs: DataFrame, did: str, tokens: Column, wanted: DataFrame | None = None, max_ratio: float = 0.10, k1: float = 1.5, b: float = 0.75) -> Index:
    """Index of the documents, or of the wanted terms' postings only; terms of more than max_ratio of the documents have none."""
    raw, stats = retrieve.bm25_index(docs, did, tokens, max_ratio, wanted)
    norm = F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.greatest(F.col("doc_len"), F.lit(1)) / F.col("avgdl"))
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / BLOCK))
    rows = raw.crossJoin(F.broadcast(stats.select("n"))).select("term", F.col(did).alias("doc"), F.pmod(F.xxhash64(did), blocks).alias("block"), (F.col("idf") * F.col("tf") * F.lit(k1 + 1) / norm).alias("impact"), "df")
    postings = write_once(rows.sortWithinPartitions("term", F.desc("impact")), "postings")
    tops = write_once(postings.groupBy("term", "block").agg(F.max("impact").alias("top"), F.first("df").alias("df")), "block-maxima")
    return Index(postings.drop("df"), tops.groupBy("term").agg(F.first("df").alias("df"), F.max("top").alias("top")), tops.drop("df"), stats)


def _scores(pairs: DataFrame, index: Index, asked: DataFrame) -> DataFrame:
    """Full scores of the given (q, doc) pairs."""
    met = index.postings.join(pairs, "doc").join(asked.select("q", "term"), ["q", "term"])
    return met.groupBy("q", "doc").agg(F.round(F.sum("impact"), 9).alias("score"))


def search(index: Index, q_terms: DataFrame, qid: str, did: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The first k documents of each question (qid, did, score, rank), and the pairs that were scored in full (q, doc)."""
    few = retrieve._few(q_terms)
    small = F.broadcast if few else lambda df: df
    asked = write_once(q_terms.select(F.col(qid).alias("q"), "term").distinct().join(index.terms.select("term", "top"), "term"), "asked")
    best = Window.partitionBy("term").orderBy(F.desc("impact"), "doc")
    champions = index.postings.join(small(asked.select("term").distinct()), "term", "left_semi").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    parts = champions.join(asked, "term").groupBy("q", "doc").agg(F.sum("impact").alias("score"))
    guesses = write_once(retrieve.top(parts, ["q"], [F.desc("score"), F.col("doc")], GUESSES * k).select("q", "doc"), "guesses")
    guessed = _scores(guesses, index, asked)
    low = retrieve.top(guessed, ["q"], [F.desc("score"), F.col("doc")], k).groupBy("q").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0.0).alias("low"))
    rising = Window.partitionBy("q").orderBy("top", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parted = asked.join(low, "q").withColumn("leads", F.sum("top").over(rising) >= F.col("low") - MARGIN)
    parted = write_once(parted, "parted")
    rest = parted.where("not leads").join(index.blocks.select("term", "block", F.col("top").alias("most")), "term").groupBy("q", "block").agg(F.sum("most").alias("rest"))
    led = index.postings.join(small(parted.where("leads").select("q", "term", "low")), "term")
    candidates = led.groupBy("q", "doc", "block", "low").agg(F.sum("impact").alias("part"))
    able = candidates.join(rest, ["q", "block"], "left").where(F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.col("low") - MARGIN)
    more = write_once(able.select("q", "doc").join(guesses, ["q", "doc"], "left_anti"), "more")
    scored = guessed.unionByName(_scores(more, index, asked))
    found = retrieve.top(scored, ["q"], [F.desc("score"), F.col("doc")], k)
    return found.select(F.col("q").alias(qid), F.col("doc").alias(did), "score", "rank"), guesses.union(more)
