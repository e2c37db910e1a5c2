"""Admission: support, currency, authority and rank terms, and the policy over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import dates
from lodestar.operators import retrieve

# Default weights, thresholds and the authority of tiers and source categories.
WEIGHTS = {"support": 0.50, "currency": 0.30, "rerank": 0.0, "authority": 0.20}
THRESHOLD, HALF_LIFE, SUPERSEDED, UNTIERED = 0.45, 5.0, 0.5, 0.40
TIERS = {"clinical-practice-guideline": 1.00, "appropriate-use-criteria": 0.85, "diagnostic-criteria": 0.85, "consensus-recommendation": 0.70}
CATEGORIES = {"currency-pack": 0.60, "pmc-fulltext": 0.45, "pubmed-abstract": 0.40}
TERMS = ("support", "currency", "rerank", "authority")


def support(q_terms: DataFrame, d_terms: DataFrame, frequency: DataFrame, pairs: DataFrame, qid: str, did: str, corpus_size: Column) -> DataFrame:
    """Half coverage, half share of inverse-frequency weight, for given (question, passage) pairs; sums are rounded to 9 places."""
    weighted, totals = _weights(q_terms, frequency, qid, corpus_size)
    hits = pairs.join(weighted, qid).join(d_terms, [did, "term"]).groupBy(qid, did).agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("hit"))
    scored = pairs.join(totals, qid, "left").join(hits, [qid, did], "left").na.fill(0, ["m", "hit"])
    return scored.select(qid, did, F.col("m").cast("long").alias("matched"), _sigma().alias("support"))


def support_of_matches(q_terms: DataFrame, d_terms: DataFrame, frequency: DataFrame, qid: str, did: str, corpus_size: Column) -> DataFrame:
    """M01 of every pair with a common term, in one pass over the passages' terms; any other pair has support 0."""
    weighted, totals = _weights(q_terms, frequency, qid, corpus_size)
    asked = weighted.join(totals, qid).select(qid, "term", "w", "n", "total")
    hits = d_terms.join(F.broadcast(asked) if retrieve._few(q_terms) else asked, "term").groupBy(qid, did)
    scored = hits.agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("hit"), F.first("n").alias("n"), F.first("total").alias("total"))
    return scored.select(qid, did, F.col("m").cast("long").alias("matched"), _sigma().alias("support"))


def _weights(q_terms: DataFrame, frequency: DataFrame, qid: str, corpus_size: Column) -> tuple[DataFrame, DataFrame]:
    """Each question's terms with their weight, and each question's number of terms and total."""
    idf = F.ln((corpus_size + 1.0) / (F.col("df") + 1.0)) + 1.0
    weighted = q_terms.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("w", idf)
    return weighted, weighted.groupBy(qid).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"))


def _sigma() -> Column:
    sigma = F.when(F.col("n") > 0, 0.5 * F.col("m") / F.col("n") + 0.5 * F.col("hit") / F.col("total")).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), sigma), 9)


def currency(retracted: Column, time_sensitive: Column, published: Column, superseded: Column, as_of: float, half_life: Column | float = HALF_LIFE, discount: float = SUPERSEDED) -> tuple[Column, Column]:
    """Value (to 9 places) and state; age never rejects, it only weighs less."""
    fresh = dates.decay(published, as_of, half_life)
    state = F.when(retracted, "retracted").when(~time_sensitive, "not_time_sensitive").when(published.isNull(), "undated").when(superseded, "superseded").otherwise("current")
    value = F.when(retracted, 0.0).when(~time_sensitive, 1.0).when(published.isNull(), 0.5).when(superseded, discount * fresh).otherwise(fresh)
    return F.round(value, 9), state


def authority(tier: Column, category: Column, tiers: dict[str, float] = TIERS, categories: dict[str, float] = CATEGORIES) -> tuple[Column, Column]:
    """Value and its basis: the tier, else the source category, else the default of the untiered."""
    lookup = lambda m, key: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[key]
    by_tier, by_category = lookup(tiers, F.nullif(tier, F.lit(""))), lookup(categories, category)
    basis = F.when(by_tier.isNotNull(), "authority_tier_label").when(by_category.isNotNull(), "source_category").otherwise("untiered_default")
    return F.coalesce(by_tier, by_category, F.lit(UNTIERED)), basis


def rank_score(rank: Column, depth: Column) -> Column:
    """1 for the first rank to 0 for the last; one half without a rank or with a single candidate."""
    clamped = F.least(F.greatest(rank, F.lit(1)), depth)
    return F.when(rank.isNull() | (depth <= 1), 0.5).otherwise((depth - clamped) / F.nullif(depth - 1, F.lit(0)))


def weighted(weights: dict[str, Column | float]) -> Column:
    """The weighted sum of the term columns, to 12 places; the terms have 9."""
    total = F.lit(0.0)
    for name in TERMS:
        w = weights.get(name, 0.0)
        total = total + (w if isinstance(w, Column) else F.lit(float(w))) * F.col(name)
    return F.round(total, 12)


def decide(df: DataFrame, weights: dict[str, Column | float] = WEIGHTS, threshold: Column | float = THRESHOLD, gate: str = "retracted") -> DataFrame:
    """Score, admitted, and the gate that fired; retraction rejects whatever the score."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    out = df.withColumn("score", weighted(weights))
    return out.withColumns({"admitted": ~F.col(gate) & (F.col("score") >= limit), "gate": F.when(F.col(gate), "retracted").when(F.col("score") >= limit, "").otherwise("threshold")})


def cap(df: DataFrame, by: str, most: int, *order: Column) -> DataFrame:
    """Of the admitted, the best `most` of each question stay; the others get the gate max_admit."""
    place = F.row_number().over(Window.partitionBy(by, "admitted").orderBy(*order))
    over = F.col("admitted") & (F.col("_place") > most)
    return df.withColumn("_place", place).withColumn("gate", F.when(over, "max_admit").otherwise(F.col("gate"))).withColumn("admitted", F.col("admitted") & ~over).drop("_place")


def abstentions(df: DataFrame, by: str) -> DataFrame:
    """Questions with candidates of which none is admitted."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("candidates"), (~F.bool_or("admitted")).alias("abstained"))


def rescore(df: DataFrame, configs: DataFrame, gate: str = "retracted") -> DataFrame:
    """Every record under every configuration row (w_*, threshold, renormalise); the gate is kept.

    configs is a table of a few rows that the caller writes, so it is broadcast.
    """
    rows = df.crossJoin(F.broadcast(configs))
    total = sum((F.col(f"w_{t}") for t in TERMS[1:]), F.col(f"w_{TERMS[0]}"))
    scale = F.when(F.col("renormalise") & (total > 0), total).otherwise(F.lit(1.0))
    return decide(rows, {t: F.col(f"w_{t}") / scale for t in TERMS}, F.col("threshold"), gate)


def ablation_summary(rescored: DataFrame, config: str, qid: str) -> DataFrame:
    """Admitted, rate, questions without evidence, per configuration; two levels, question then configuration."""
    per = rescored.groupBy(config, qid).agg(F.count(F.lit(1)).alias("n"), F.count_if("admitted").alias("k"))
    return per.groupBy(config).agg(
        F.sum("n").alias("candidates"), F.sum("k").alias("admitted"), F.count(F.lit(1)).alias("questions"), F.count_if(F.col("k") == 0).alias("zero_evidence"), F.round(F.sum("k") / F.sum("n"), 9).alias("rate")
    )
