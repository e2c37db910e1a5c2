"""Comparison of two arms over one candidate set, summaries, and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieve import top


def admission_by(df: DataFrame, key: Column) -> DataFrame:
    """Candidates, admitted and rate for each value of a key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("admitted").alias("admitted"), F.round(F.count_if("admitted") / F.count(F.lit(1)), 9).alias("rate"))


def arm_summary(rows: DataFrame, arm: str, by: str, admitted: str, chars: str, error: str) -> DataFrame:
    """Of each arm the questions attempted, failed and without evidence, and what the others admitted.

    A question failed if any of its rows has an error, and then counts for nothing else. Two aggregations, by (arm,
    question) and by arm, both combined before the shuffle; means and rates are 0 where no question succeeded.
    """
    per = rows.groupBy(arm, by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(admitted).alias("k"), F.sum(F.when(F.col(admitted), F.col(chars)).otherwise(0)).alias("chars"), (F.count(error) > 0).alias("failed"),
    )
    ok = ~F.col("failed")
    done = F.count_if(ok)
    of = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    mean = lambda c, places: F.coalesce(F.round(F.try_divide(of(c).cast("double"), done.cast("double")), places), F.lit(0.0))
    return per.groupBy(arm).agg(
        F.count(F.lit(1)).alias("attempted"), done.alias("succeeded"), F.count_if("failed").alias("failed"), mean("n", 3).alias("mean_candidates"), mean("k", 3).alias("mean_admitted"),
        of("k").alias("total_admitted"), of("n").alias("total_candidates"), F.coalesce(F.round(F.try_divide(of("k").cast("double"), of("n").cast("double")), 6), F.lit(0.0)).alias("admission_rate"),
        F.count_if(ok & (F.col("k") == 0)).alias("no_evidence"), mean("chars", 1).alias("mean_context_chars"),
    )


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """The two-by-two table of two binary arms, their rates, and the Jaccard of what they admit (null if nothing)."""
    x, y, n = F.col(a), F.col(b), F.count(F.lit(1))
    return df.agg(
        F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(y & ~x).alias("only_b"), F.count_if(~x & ~y).alias("neither"),
        F.round(F.try_divide(F.count_if(x), n), 9).alias("rate_a"), F.round(F.try_divide(F.count_if(y), n), 9).alias("rate_b"), F.round(F.try_divide(F.count_if(x & y), F.count_if(x | y)), 9).alias("jaccard"),
    )


def paired(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Per question, how much each arm admits and how far they agree, without collecting ids."""
    x, y = F.col(a), F.col(b)
    return df.groupBy(by).agg(F.count_if(x).alias("n_a"), F.count_if(y).alias("n_b"), F.count_if(x & y).alias("both"), F.round(F.try_divide(F.count_if(x & y), F.count_if(x | y)), 9).alias("jaccard"))


def matched_k(df: DataFrame, by: str, id_: str, a: str, b: str, k: int) -> DataFrame:
    """Overlap of each arm's own top k, thresholds aside."""
    picked = [top(df, [by], [F.desc(s), F.col(id_)], k).select(by, id_, F.lit(i).alias("arm")) for i, s in enumerate((a, b))]
    per_id = picked[0].union(picked[1]).groupBy(by, id_).agg(F.count(F.lit(1)).alias("arms"))
    return per_id.groupBy(by).agg(F.count_if(F.col("arms") == 2).alias("both"), F.round(F.count_if(F.col("arms") == 2) / F.count(F.lit(1)), 9).alias("jaccard"))


def quality_at(ranked: DataFrame, labels: DataFrame, id_: str, label: str, ks: list[int]) -> DataFrame:
    """Mean label of the labelled rows inside the top k, for several k from one ranking (column place)."""
    inside = ranked.join(labels.select(id_, label), id_).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("place") <= F.col("k"))
    return inside.groupBy("k").agg(F.count(F.lit(1)).alias("labelled"), F.round(F.avg(label), 9).alias(f"mean_{label}"))


def variance_shares(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean, deviation and range of each term, and its share of the weighted variance; one pass over the rows."""
    terms = list(weights)
    long = df.unpivot([], terms, "term", "v").groupBy("term").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"), F.var_pop("v").alias("var"))
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("term")]
    part = w * w * F.col("var")
    return long.withColumn("share", F.round(F.try_divide(part, F.sum(part).over(Window.partitionBy())), 9)).select("term", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "low", "high")], "share")


def label_tree(without: Column, with_: Column, delta: Column, tau: Column) -> Column:
    """A passage that breaks a right answer is discarded; else it helps if it repairs or lowers surprise by tau."""
    return F.when(without & ~with_, "DISCARD").when(delta >= tau, "HELPFUL").otherwise("NOT_HELPFUL")


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Accuracy of each class and overall; -1 for a class that never occurs."""
    hit = F.col(gold) == F.col(predicted)
    rate = lambda ok: F.coalesce(F.round(F.try_divide(F.count_if(hit & ok), F.count_if(ok)), 9), F.lit(-1.0))
    return df.agg(F.count(F.lit(1)).alias("n"), rate(F.lit(True)).alias("accuracy"), rate(F.col(gold) == 1).alias("accuracy_1"), rate(F.col(gold) == 0).alias("accuracy_0"), F.count_if(F.col(predicted) == 1).alias("predicted_1"), F.count_if(F.col(gold) == 1).alias("gold_1"))
