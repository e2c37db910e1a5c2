"""Human judgements against decisions: joins that lose no row, summaries, and audits as rows (check, status, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats


def resolved(annotations: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """Every annotation with its decision; `matched` is false, and the decision null, where there is none."""
    return annotations.join(decisions.withColumn("_there", F.lit(True)), key, "left").withColumn("matched", F.col("_there").isNotNull()).drop("_there")


def pass_comparison(first: DataFrame, second: DataFrame, id_: str, label: str, valid: list[int]) -> DataFrame:
    """Labels of one id in two passes, where both are valid."""
    side = lambda df, n: df.where(F.col(label).isin(valid)).select(id_, F.col(label).alias(n))
    return side(first, "label_1").join(side(second, "label_2"), id_).withColumn("change", F.col("label_2") - F.col("label_1"))


def summary(df: DataFrame, by: list[str | Column], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 9).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def overlapping_groups(df: DataFrame, groups: dict[str, Column], value: str) -> DataFrame:
    """Rows summarised by predicates that may overlap: one pass, each row goes to each of its groups."""
    tags = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in groups.items()]), lambda x: x.isNotNull())
    return summary(df.withColumn("group", F.explode(tags)), ["group"], value)


def discrimination(df: DataFrame, terms: list[str], admitted: str) -> DataFrame:
    """Of each term the spread, its means when admitted and when not, and their difference.

    Values are counted first, so distinct values and median come from counts and no task sorts the rows.
    """
    long = df.unpivot([admitted], terms, "term", "v").where("v is not null")
    counts = long.groupBy("term", "v", admitted).agg(F.count(F.lit(1)).alias("c"))
    yes, no = F.col(admitted), ~F.col(admitted)
    mean = lambda ok: F.try_divide(F.sum(F.when(ok, F.col("v") * F.col("c"))), F.sum(F.when(ok, F.col("c"))).cast("double"))
    out = counts.groupBy("term").agg(
        F.count_distinct("v").alias("distinct_values"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.round(mean(yes), 6).alias("mean_admitted"), F.round(mean(no), 6).alias("mean_rejected"), F.round(mean(yes) - mean(no), 6).alias("difference"),
    )
    middle = stats.quantile(long.select("term", F.col("v").cast("double").alias("v")), "v", 0.5, ["term"], "median")
    return out.join(middle.withColumn("median", F.round("median", 6)), "term")


def clusters(df: DataFrame, by: str) -> DataFrame:
    """How the rows spread over their clusters."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("s"))
    return sizes.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("clusters"), F.coalesce(F.min("s"), F.lit(0)).alias("smallest"), F.coalesce(F.max("s"), F.lit(0)).alias("largest"), F.round(F.avg("s"), 4).alias("mean"))


def agreement(df: DataFrame, now: str, before: str) -> DataFrame:
    """Decisions that a configuration changes, and which way."""
    a, b = F.col(now), F.col(before)
    return df.agg(F.count_if(a != b).alias("changed"), F.count_if(a & ~b).alias("newly_admitted"), F.count_if(~a & b).alias("newly_rejected"), F.count_if(a == b).alias("unchanged"))


def overlap_histogram(per_question: DataFrame, overlap: str) -> DataFrame:
    """Questions by the size of their overlap."""
    return per_question.groupBy(overlap).agg(F.count(F.lit(1)).alias("questions"))


def component_grid(df: DataFrame, variants: DataFrame, terms: list[str], threshold: float) -> DataFrame:
    """What reduced weights (variant, w_<term>) admit, and the highest score that they can give.

    variants is a written list of a few rows; each row of df is scored against all of it in place.
    """
    rows = df.crossJoin(F.broadcast(variants))
    score = sum((F.col(f"w_{t}") * F.coalesce(F.col(t), F.lit(0.0)) for t in terms), F.lit(0.0))
    most = sum((F.col(f"w_{t}") for t in terms), F.lit(0.0))
    return rows.groupBy("variant").agg(F.count_if(F.round(score, 12) >= threshold).alias("admitted"), F.count(F.lit(1)).alias("candidates"), F.round(F.max(most), 4).alias("max_possible"))


def counters(df: DataFrame, reasons: dict[str, Column], otherwise: str = "kept") -> DataFrame:
    """Rows by the first reason that holds; a null test does not hold."""
    reason = None
    for name, test in reasons.items():
        reason = F.when(test, name) if reason is None else reason.when(test, name)
    return df.groupBy(reason.otherwise(otherwise).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def max_over_windows(df: DataFrame, sample: str, score: str) -> DataFrame:
    """The best window of each sample."""
    return df.groupBy(sample).agg(F.max(score).alias(score), F.count(F.lit(1)).alias("windows"))


def two_way_softmax(helpful: Column, other: Column) -> Column:
    """The probability of the first of two logits; the exponent is never positive, so nothing overflows."""
    gap = helpful - other
    small = F.exp(-F.abs(gap))
    return F.when(gap >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def census(df: DataFrame, by: list[str], present: Column, id_: str, examples: int = 5) -> DataFrame:
    """A10: rows with and without a value, and the first few ids without."""
    missing = ~F.coalesce(present, F.lit(False))
    counts = df.groupBy(*by).agg(F.count_if(~missing).alias("dated"), F.count_if(missing).alias("undated"))
    from pyspark.sql import Window

    first = df.where(missing).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(id_))).where(F.col("_k") <= examples)
    shown = first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(id_)), lambda x: x.cast("string")), ",").alias("examples"))
    return counts.join(shown, by, "left").withColumn("examples", F.coalesce("examples", F.lit("")))


def finding(check: str, bad: Column, soft: bool = False) -> Column:
    """A struct (check, status, detail) of a count of bad rows: PASS at none, else FAIL, or WARN if soft."""
    return F.struct(F.lit(check).alias("check"), F.when(bad == 0, "PASS").otherwise("WARN" if soft else "FAIL").alias("status"), bad.cast("string").alias("detail"))


def findings(df: DataFrame, rules: dict[str, Column], soft: frozenset[str] = frozenset()) -> DataFrame:
    """One aggregate of counts, one row of (check, status, detail) for each; rules are aggregates of bad rows."""
    counted = df.agg(*[F.coalesce(rule, F.lit(0)).alias(f"b{i}") for i, rule in enumerate(rules.values())])
    rows = F.array(*[finding(name, F.col(f"b{i}"), name in soft) for i, name in enumerate(rules)])
    return counted.select(F.explode(rows).alias("f")).select("f.*")


def copied_labels(df: DataFrame, label: Column, suggested: Column, shown: Column) -> DataFrame:
    """Q08: labels that never differ from a suggestion that was always shown are no judgement; hidden agreement only warns."""
    both = label.isNotNull() & suggested.isNotNull()
    out = df.agg(F.count_if(both).alias("n"), F.count_if(both & (label != suggested)).alias("differ"), F.count_if(both & ~F.coalesce(shown, F.lit(False))).alias("hidden"))
    status = F.when((F.col("n") == 0) | (F.col("differ") > 0), "PASS").when(F.col("hidden") == 0, "FAIL").otherwise("WARN")
    return out.select(F.lit("label_not_copied").alias("check"), status.alias("status"), F.concat_ws("/", "differ", "n").alias("detail"))
