"""Queries over scored, dated evidence: `events` as candidates of question clusters (user_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalog import query, table
from lodestar.functions import dates
from lodestar.operators import admit, compare, layers, retrieve, stats

AS_OF = 2026.0
TIERS = "case event_type when 'view' then 'clinical-practice-guideline' when 'click' then 'diagnostic-criteria' when 'purchase' then 'consensus-recommendation' else '' end"
CATEGORY = "case when event_id % 3 = 0 then 'currency-pack' when event_id % 3 = 1 then 'pmc-fulltext' else 'other' end"

# The four terms of a candidate; every ranking ends with its id.
CAND = f"""cand as (select *, case when tier = 'clinical-practice-guideline' then 1.0 when tier = 'diagnostic-criteria' then 0.85 when tier = 'consensus-recommendation' then 0.7
    when category = 'currency-pack' then 0.6 when category = 'pmc-fulltext' then 0.45 else 0.4 end as authority,
    case when tier <> '' then 'authority_tier_label' when category in ('currency-pack', 'pmc-fulltext') then 'source_category' else 'untiered_default' end as basis,
    case when retracted then 'retracted' when not time_sensitive then 'not_time_sensitive' when published is null then 'undated' when superseded then 'superseded' else 'current' end as state,
    case when rank is null or depth <= 1 then 0.5 else (depth - least(greatest(rank, 1), depth)) / (depth - 1) end as rerank
  from (select event_id, user_id, event_type, value, {TIERS} as tier, {CATEGORY} as category, event_id % 97 = 0 as retracted, user_id % 5 <> 0 as time_sensitive, event_id % 11 = 0 as superseded,
      case when event_id % 13 <> 0 then 2000 + event_id % 27 + 0.5 end as published, round(least(1.0, abs(value) / 200), 9) as support,
      row_number() over (partition by user_id order by value desc, event_id)::int as rank, count(*) over (partition by user_id)::int as depth from events)),
scored as (select *, round(case when retracted then 0.0 when not time_sensitive then 1.0 when published is null then 0.5 else (case when superseded then 0.5 else 1.0 end) * power(2.0, -greatest(0.0, 2026.0 - published) / 5.0) end, 9) as currency from cand),
dec as (select *, round(0.5 * support + 0.3 * currency + 0.0 * rerank + 0.2 * authority, 12) as score from scored),
adm as (select *, not retracted and score >= 0.45 as admitted, case when retracted then 'retracted' when score >= 0.45 then '' else 'threshold' end as gate from dec)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = F.col("event_id")
    rows = e.select(
        "event_id", "user_id", "event_type", "value",
        F.when(F.col("event_type") == "view", "clinical-practice-guideline").when(F.col("event_type") == "click", "diagnostic-criteria").when(F.col("event_type") == "purchase", "consensus-recommendation").otherwise("").alias("tier"),
        F.when(n % 3 == 0, "currency-pack").when(n % 3 == 1, "pmc-fulltext").otherwise("other").alias("category"),
        (n % 97 == 0).alias("retracted"), (F.col("user_id") % 5 != 0).alias("time_sensitive"), (n % 11 == 0).alias("superseded"),
        F.when(n % 13 != 0, 2000 + n % 27 + F.lit(0.5)).alias("published"), F.round(F.least(F.lit(1.0), F.abs("value") / 200), 9).alias("support"),
    )
    ranked = retrieve.rerank(rows, "user_id", "value", "event_id").withColumnRenamed("rerank_rank", "rank")
    depth = rows.groupBy(F.col("user_id").alias("_u")).agg(F.count(F.lit(1)).cast("int").alias("depth"))
    ranked = ranked.join(depth, F.col("user_id") == F.col("_u")).drop("_u")
    value, state = admit.currency(F.col("retracted"), F.col("time_sensitive"), F.col("published"), F.col("superseded"), AS_OF)
    tau, basis = admit.authority(F.col("tier"), F.col("category"))
    return ranked.withColumns({"currency": value, "state": state, "authority": tau, "basis": basis, "rerank": admit.rank_score(F.col("rank"), F.col("depth"))})


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return admit.decide(candidates(spark, d))


@query(f"with {CAND} select event_id, currency, state from scored")
def currency_gamma(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("event_id", "currency", "state")


@query(f"with {CAND} select event_id, authority::double as authority, basis from cand")
def authority_tau(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("event_id", "authority", "basis")


@query(f"with {CAND} select event_id, rank, depth, round(rerank, 12) as rerank from cand")
def rank_rho(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("event_id", "rank", "depth", F.round("rerank", 12).alias("rerank"))


@query(f"with {CAND} select event_id, user_id, score, admitted, gate from adm")
def admission_decisions(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).select("event_id", "user_id", "score", "admitted", "gate")


@query(f"with {CAND}, p as (select *, row_number() over (partition by user_id, admitted order by score desc, event_id) as k from adm) select event_id, admitted and k <= 3 as admitted, case when admitted and k > 3 then 'max_admit' else gate end as gate from p")
def admission_capped(spark: SparkSession, d: str) -> DataFrame:
    return admit.cap(decisions(spark, d), "user_id", 3, F.desc("score"), F.col("event_id")).select("event_id", "admitted", "gate")


@query(f"with {CAND} select user_id, count(*)::bigint as candidates, not bool_or(admitted) as abstained from adm group by user_id")
def abstentions(spark: SparkSession, d: str) -> DataFrame:
    return admit.abstentions(decisions(spark, d), "user_id")


CONFIGS = [("run", 0.5, 0.3, 0.0, 0.2, 0.45, False), ("a4_support", 1.0, 0.0, 0.0, 0.0, 0.45, False), ("a5_raw", 0.5, 0.0, 0.0, 0.2, 0.45, False), ("a5_renorm", 0.5, 0.0, 0.0, 0.2, 0.45, True), ("a7_raw", 0.0, 0.3, 0.0, 0.2, 0.45, False), ("a7_renorm", 0.0, 0.3, 0.0, 0.2, 0.45, True), ("a12a_raw", 0.5, 0.3, 0.0, 0.0, 0.45, False), ("a12a_renorm", 0.5, 0.3, 0.0, 0.0, 0.45, True), ("rho_10", 0.45, 0.25, 0.1, 0.2, 0.45, False), ("rho_20", 0.4, 0.2, 0.2, 0.2, 0.45, False)]
CONFIG_SQL = "cfg(config_id, ws, wc, wr, wa, theta, renorm) as (values " + ", ".join(f"('{c[0]}', {c[1]}::double, {c[2]}::double, {c[3]}::double, {c[4]}::double, {c[5]}::double, {str(c[6]).lower()})" for c in CONFIGS) + ")"
GRID = """sc as (select config_id, user_id, event_id, not retracted and round(ws / s * support + wc / s * currency + wr / s * rerank + wa / s * authority, 12) >= theta as admitted
  from (select *, case when renorm and ws + wc + wr + wa > 0 then ws + wc + wr + wa else 1.0 end as s from scored, cfg)),
per as (select config_id, user_id, count(*) as n, count(*) filter (where admitted) as k from sc group by all)"""
GRID_OUT = "select config_id, sum(n)::bigint as candidates, sum(k)::bigint as admitted, count(*)::bigint as questions, count(*) filter (where k = 0)::bigint as zero_evidence, round(sum(k) / sum(n), 9) as rate from per group by config_id"


def _configs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "config_id string, w_support double, w_currency double, w_rerank double, w_authority double, threshold double, renormalise boolean")


@query(f"with {CAND}, {CONFIG_SQL}, {GRID} {GRID_OUT}")
def ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    return admit.ablation_summary(admit.rescore(candidates(spark, d), _configs(spark, CONFIGS)), "config_id", "user_id")


SWEEP = [(f"{t:.2f}", 0.5, 0.3, 0.0, 0.2, t, False) for t in (0.30, 0.40, 0.45, 0.50, 0.60, 0.70)]
SWEEP_SQL = "cfg(config_id, ws, wc, wr, wa, theta, renorm) as (values " + ", ".join(f"('{c[0]}', 0.5::double, 0.3::double, 0.0::double, 0.2::double, {c[5]}::double, false)" for c in SWEEP) + ")"


@query(f"with {CAND}, {SWEEP_SQL}, {GRID} {GRID_OUT}")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return admit.ablation_summary(admit.rescore(candidates(spark, d), _configs(spark, SWEEP)), "config_id", "user_id")


LIVES = (1.0, 2.0, 3.0, 5.0, 8.0, 20.0)


@query(f"""with {CAND}, l(h) as (values {', '.join(f'({h}::double)' for h in LIVES)}),
x as (select h, not retracted and round(0.5 * support + 0.3 * round(case when retracted then 0.0 when not time_sensitive then 1.0 when published is null then 0.5 else (case when superseded then 0.5 else 1.0 end) * power(2.0, -greatest(0.0, 2026.0 - published) / h) end, 9) + 0.0 * rerank + 0.2 * authority, 12) >= 0.45 as a from cand, l)
select h as half_life, count(*)::bigint as candidates, count(*) filter (where a)::bigint as admitted from x group by h""")
def half_life_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).withColumn("half_life", F.explode(F.array(*map(F.lit, LIVES))))
    value, _ = admit.currency(F.col("retracted"), F.col("time_sensitive"), F.col("published"), F.col("superseded"), AS_OF, F.col("half_life"))
    return admit.decide(rows.withColumn("currency", value)).groupBy("half_life").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("admitted").alias("admitted"))


@query(f"""with {CAND}, u as (select 'support' as term, 0.5 as w, support as v from scored union all select 'currency', 0.3, currency from scored union all select 'rerank', 0.0, rerank from scored union all select 'authority', 0.2, authority from scored),
a as (select term, any_value(w) as w, round(avg(v), 9) as mean, round(stddev_pop(v), 9) as sd, min(v) as low, max(v) as high, var_pop(v) as var from u group by term)
select term, mean, sd, round(low, 9) as low, round(high, 9) as high, round(w * w * var / sum(w * w * var) over (), 9) as share from a""")
def variance_shares(spark: SparkSession, d: str) -> DataFrame:
    return compare.variance_shares(candidates(spark, d), {t: admit.WEIGHTS[t] for t in admit.TERMS})


@query(f"with {CAND} select category, count(*)::bigint as candidates, count(*) filter (where admitted)::bigint as admitted, round(count(*) filter (where admitted) / count(*), 9) as rate from adm group by category")
def admission_by_source(spark: SparkSession, d: str) -> DataFrame:
    return compare.admission_by(decisions(spark, d), F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown")).alias("category"))


@query(f"with {CAND} select substr(published::varchar, 1, 4) as year, count(*)::bigint as candidates, count(*) filter (where admitted)::bigint as admitted, round(count(*) filter (where admitted) / count(*), 9) as rate from adm group by all")
def admission_by_year(spark: SparkSession, d: str) -> DataFrame:
    return compare.admission_by(decisions(spark, d), F.substring(F.col("published").cast("string"), 1, 4).alias("year"))


@query(f"with {CAND} select case when published is null then 'undated' when published < 2020 then 'older' else 'newer' end as bucket, count(*)::bigint as candidates, count(*) filter (where admitted)::bigint as admitted, round(count(*) filter (where admitted) / count(*), 9) as rate from adm group by all")
def recency_profile(spark: SparkSession, d: str) -> DataFrame:
    bucket = F.when(F.col("published").isNull(), "undated").when(F.col("published") < 2020, "older").otherwise("newer")
    return compare.admission_by(decisions(spark, d), bucket.alias("bucket"))


ARMS = f"{CAND}, arms as (select user_id, event_id, admitted as a, support >= 0.3 and not retracted as b, score as sa, support as sb from adm)"


def _arms(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).select("user_id", "event_id", F.col("admitted").alias("a"), ((F.col("support") >= 0.3) & ~F.col("retracted")).alias("b"), F.col("score").alias("sa"), F.col("support").alias("sb"))


@query(f"""with {ARMS} select count(*) filter (where a and b)::bigint as both, count(*) filter (where a and not b)::bigint as only_a, count(*) filter (where b and not a)::bigint as only_b, count(*) filter (where not a and not b)::bigint as neither,
round(count(*) filter (where a) / count(*), 9) as rate_a, round(count(*) filter (where b) / count(*), 9) as rate_b, round(count(*) filter (where a and b) / nullif(count(*) filter (where a or b), 0), 9) as jaccard from arms""")
def contingency_2x2(spark: SparkSession, d: str) -> DataFrame:
    return compare.contingency(_arms(spark, d), "a", "b")


@query(f"""with {ARMS}, u as (select 'first' as arm, user_id, a as admitted, value, case when value is null then 'no score' end as error from arms join (select event_id, value from events) using (event_id) union all select 'second', user_id, b, value, case when value < 0 then 'negative score' end from arms join (select event_id, value from events) using (event_id)),
p as (select arm, user_id, count(*) as n, count(*) filter (where admitted) as k, sum(case when admitted then length(round(value)::bigint::varchar) else 0 end) as chars, count(error) > 0 as failed from u group by all), o as (select *, not failed as ok from p)
select arm, count(*)::bigint as attempted, count(*) filter (where ok)::bigint as succeeded, count(*) filter (where failed)::bigint as failed, coalesce(round(sum(n) filter (where ok) / count(*) filter (where ok), 3), 0.0)::double as mean_candidates, coalesce(round(sum(k) filter (where ok) / count(*) filter (where ok), 3), 0.0)::double as mean_admitted,
coalesce(sum(k) filter (where ok), 0)::bigint as total_admitted, coalesce(sum(n) filter (where ok), 0)::bigint as total_candidates, coalesce(round(sum(k) filter (where ok) / sum(n) filter (where ok), 6), 0.0)::double as admission_rate, count(*) filter (where ok and k = 0)::bigint as no_evidence, coalesce(round(sum(chars) filter (where ok) / count(*) filter (where ok), 1), 0.0)::double as mean_context_chars from o group by arm""")
def arm_summary(spark: SparkSession, d: str) -> DataFrame:
    """Both arms' questions, failures, admissions and context; an arm fails on a question by an event that it can't score."""
    rows = _arms(spark, d).join(table(spark, d, "events").select("event_id", "value"), "event_id")
    chars = F.length(F.round("value").cast("bigint").cast("string"))
    value = F.col("value")
    arms = [rows.select(F.lit(name).alias("arm"), "user_id", F.col(c).alias("admitted"), chars.alias("chars"), F.when(test, F.lit(why)).alias("error")) for name, c, test, why in (("first", "a", value.isNull(), "no score"), ("second", "b", value < 0, "negative score"))]
    return compare.arm_summary(arms[0].union(arms[1]), "arm", "user_id", "admitted", "chars", "error")


@query(f"""with {ARMS} select user_id, count(*) filter (where a)::bigint as n_a, count(*) filter (where b)::bigint as n_b, count(*) filter (where a and b)::bigint as both,
round(count(*) filter (where a and b) / nullif(count(*) filter (where a or b), 0), 9) as jaccard from arms group by user_id""")
def paired_comparison(spark: SparkSession, d: str) -> DataFrame:
    return compare.paired(_arms(spark, d), "user_id", "a", "b")


@query(f"""with {ARMS}, ra as (select user_id, event_id, row_number() over (partition by user_id order by sa desc, event_id) as k from arms qualify k <= 5), rb as (select user_id, event_id, row_number() over (partition by user_id order by sb desc, event_id) as k from arms qualify k <= 5),
s as (select coalesce(ra.user_id, rb.user_id) as user_id, count(*) filter (where ra.event_id is not null and rb.event_id is not null) as "both", count(*) as either from ra full join rb on ra.user_id = rb.user_id and ra.event_id = rb.event_id group by 1)
select user_id, "both"::bigint as "both", round("both" / either, 9) as jaccard from s""")
def matched_k_selection(spark: SparkSession, d: str) -> DataFrame:
    return compare.matched_k(_arms(spark, d), "user_id", "event_id", "sa", "sb", 5)


@query(f"""with {ARMS}, r as (select event_id, row_number() over (partition by user_id order by sa desc, event_id) as k from arms), t as (select k0, toxic, quality from r join (values (1), (3), (5), (8)) t(k0) on r.k <= k0 join labels on event_id = doc_id)
select k0 as k, count(*)::bigint as labelled, round(avg(quality), 9) as mean_quality from t group by k0""")
def topk_quality(spark: SparkSession, d: str) -> DataFrame:
    ranked = retrieve.top(_arms(spark, d), ["user_id"], [F.desc("sa"), F.col("event_id")], 8, "place")
    return compare.quality_at(ranked, table(spark, d, "labels").withColumnRenamed("doc_id", "event_id"), "event_id", "quality", [1, 3, 5, 8])


@query(f"with {CAND}, r as (select *, rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2.0 as avg_rank from events) select event_id, avg_rank from r")
def average_ranks(spark: SparkSession, d: str) -> DataFrame:
    return stats.average_ranks(table(spark, d, "events").select("event_id", "value", "event_type"), "value", ["event_type"], "avg_rank").select("event_id", "avg_rank")


@query(f"""with {CAND}, u as (select event_type, 'support' as field, support as x, rank as y from scored union all select event_type, 'currency', currency, rank from scored union all select event_type, 'authority', authority, rank from scored),
r as (select event_type, field, rank() over (partition by event_type, field order by x) + (count(*) over (partition by event_type, field, x) - 1) / 2.0 as rx, rank() over (partition by event_type, field order by y) + (count(*) over (partition by event_type, field, y) - 1) / 2.0 as ry from u)
select event_type, field, count(*)::bigint as n, case when count(*) >= 3 and stddev_pop(rx) > 0 and stddev_pop(ry) > 0 then round(corr(rx, ry), 9) end as rho from r group by all""")
def spearman_by_field(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).unpivot(["event_type", "rank"], ["support", "currency", "authority"], "field", "x")
    return stats.spearman(rows, "x", "rank", ["event_type", "field"])


EDGES = "e as (select list_sort(list(value)) as v from events where value is not null), edges as (select v[(len(v) // 3) + 1] as edge_low, v[(2 * len(v) // 3) + 1] as edge_high from e)"


@query(f"with {EDGES} select event_type, case when value < edge_low then 'low' when value < edge_high then 'medium' else 'high' end as bin, count(*)::bigint as n, any_value(edge_low) as edge_low, any_value(edge_high) as edge_high from events, edges where value is not null group by all")
def tertile_edges_bins(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value is not null")
    rows = e.crossJoin(F.broadcast(stats.tertile_edges(e, "value"))).withColumn("bin", stats.bin_of(F.col("value"), F.col("edge_low"), F.col("edge_high")))
    return rows.groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"), F.any_value("edge_low").alias("edge_low"), F.any_value("edge_high").alias("edge_high"))


@query("with s as (select quality = 1 as a, toxic = 0 as b from labels) select round(2 * asin(sqrt(avg(a::int))) - 2 * asin(sqrt(avg(b::int))), 9) as h, case when abs(round(2 * asin(sqrt(avg(a::int))) - 2 * asin(sqrt(avg(b::int))), 9)) < 0.2 then 'negligible' when abs(round(2 * asin(sqrt(avg(a::int))) - 2 * asin(sqrt(avg(b::int))), 9)) < 0.5 then 'small' when abs(round(2 * asin(sqrt(avg(a::int))) - 2 * asin(sqrt(avg(b::int))), 9)) < 0.8 then 'medium' else 'large' end as magnitude from s")
def cohens_h(spark: SparkSession, d: str) -> DataFrame:
    rates = table(spark, d, "labels").agg(F.avg((F.col("quality") == 1).cast("int")).alias("p1"), F.avg((F.col("toxic") == 0).cast("int")).alias("p2"))
    h, magnitude = stats.cohens_h(F.col("p1"), F.col("p2"))
    return rates.select(h.alias("h"), magnitude.alias("magnitude"))


MCNEMAR = "m as (select count(*) filter (where quality = 1 and toxic = 1) as k, count(*) filter (where (quality = 1) <> (toxic = 0)) as n from labels)"


@query(f"""with {MCNEMAR}, p as (select i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2) as lp, k, n from m, unnest(generate_series(0, n)) as t(i)),
o as (select lp as seen from p where i = k) select any_value(k)::bigint as k, any_value(n)::bigint as n, round(least(1.0, sum(exp(lp)) filter (where lp <= seen + 1e-9)), 6) as p from p, o""")
def mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("quality") == 1, F.col("toxic") == 0
    counts = table(spark, d, "labels").agg(F.count_if(a & ~b).alias("k"), F.count_if(a != b).alias("n"))
    return counts.select("k", "n", F.round(stats.binomial_two_sided(F.col("k"), F.col("n")), 6).alias("p"))


@query("""with t as (select event_type, round(abs(avg(value) - 100) / 1000, 9) as p from events group by event_type), r as (select *, row_number() over (order by p, event_type) as k, count(*) over () as m from t),
f as (select *, 0.05 / (m - k + 1) as threshold, max((p > 0.05 / (m - k + 1))::int) over (order by k rows unbounded preceding) as failed from r) select event_type, p, k::int as rank, failed = 0 as rejected from f""")
def holm_step_down(spark: SparkSession, d: str) -> DataFrame:
    tests = table(spark, d, "events").groupBy("event_type").agg(F.round(F.abs(F.avg("value") - 100) / 1000, 9).alias("p"))
    return stats.holm(tests, "p", 0.05, id_="event_type").select("event_type", "p", "rank", "rejected")


@query("select quantile_cont(value, 0.75) as tau from events where value is not null and isfinite(value)")
def percentile_tau(spark: SparkSession, d: str) -> DataFrame:
    good = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return stats.quantile(table(spark, d, "events").where(good), "value", 0.75, [], "tau")


@query("""with t as (select event_type, quantile_cont(value, 0.75) as tau from events group by event_type) select e.event_type, case when event_id % 2 = 0 and event_id % 3 <> 0 then 'DISCARD' when value >= tau then 'HELPFUL' else 'NOT_HELPFUL' end as label, count(*)::bigint as n from events e join t using (event_type) group by all""")
def label_tree(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds per group, then the decision tree over correctness without and with the passage."""
    e = table(spark, d, "events")
    tau = stats.quantile(e, "value", 0.75, ["event_type"], "tau")
    label = compare.label_tree(F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0, F.col("value"), F.col("tau"))
    return e.join(tau, "event_type").groupBy("event_type", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, count(*)::bigint as n, round(exp(sum(abs(value)) / 1000 / count(*)), 9) as perplexity from events group by user_id")
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.exp(F.sum(F.abs("value")) / 1000 / F.count(F.lit(1))), 9).alias("perplexity"))


@query("select user_id, max(event_id)::bigint as event_id, arg_max(event_type, (ts, event_id)) as event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1 group by user_id")
def last_wins_compaction(spark: SparkSession, d: str) -> DataFrame:
    return layers.last_wins(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select event_type, count(*)::bigint as n, count(distinct user_id)::bigint as users, round(avg(value), 6) as mean, median(value) as median, min(value) as low, max(value) as high from events group by event_type")
def distribution_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rest = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return rest.join(stats.quantile(e, "value", 0.5, ["event_type"], "median"), "event_type", "left")


@query("select event_id, date_diff('day', date '2024-01-01', ts::date)::int as age_days, (year(ts) + ((month(ts) - 1) + (least(28, day(ts)) - 1) / 30.0) / 12.0) as year_fraction, strftime(ts, '%Y-%m') as month from events")
def event_year_fraction(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, d, "events").select("event_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("age_days"), dates.year_fraction(day).alias("year_fraction"), F.date_format("ts", "yyyy-MM").alias("month"))
