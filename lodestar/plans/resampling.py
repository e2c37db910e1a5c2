"""Queries of resampling statistics: orders of one customer pair stand for older and newer passages of one question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalog import query, table
from lodestar.operators import compare, resample, stats
from lodestar.plans.evidence import CAND, decisions
from lodestar.plans.judgement import SHEET, _judged
from lodestar.stored import write_once

DRAWS, SEED, BAND = 10_000, 20260910, 0.05


def uniform_sql(draw: str, id_: str, seed: int = SEED) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {draw} || ':' || {id_}), 1, 7))::int / 268435456.0)"


def weight_sql(u: str) -> str:
    return "(" + " + ".join(f"({u} >= {c}::double)::int" for c in resample.POISSON) + ")"


def drawn_sql(units: str, id_: str, draws: int = DRAWS) -> str:
    """units x draws with w, as a subquery; the four parts of an md5 serve four draws."""
    hashed = f"select q.*, b, md5('{SEED}:' || b || ':' || {id_}) as h from {units} q, generate_series(0, {-(-draws // resample.SHARE) - 1}) g(b)"
    parts = f"select * exclude (h, b, j), b * {resample.SHARE} + j + 1 as draw, (('0x' || substr(h, 7 * j + 1, 7))::int / 268435456.0)::double as u from ({hashed}), generate_series(0, {resample.SHARE - 1}) k(j)"
    return f"(select * from (select *, {weight_sql('u')} as w from ({parts})) where w > 0 and draw <= {draws})"


PAIRS = """old as (select o_custkey as id, arg_min(o_totalprice, (o_orderdate, o_orderkey)) as a, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as b, min(o_orderdate) as t1, max(o_orderdate) as t2 from orders group by o_custkey),
pairs as (select id, round(a / (a + 200000), 6) as older, round(b / (b + 200000), 6) as newer, round(round(a / (a + 200000), 6) - round(b / (b + 200000), 6), 6) as d from old where t2 > t1)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    when = F.struct("o_orderdate", "o_orderkey")
    rows = o.groupBy(F.col("o_custkey").alias("id")).agg(F.min_by("o_totalprice", when).alias("a"), F.max_by("o_totalprice", when).alias("b"), F.min("o_orderdate").alias("t1"), F.max("o_orderdate").alias("t2")).where("t2 > t1")
    p = lambda c: F.round(F.col(c) / (F.col(c) + 200000), 6)
    return write_once(rows.select("id", p("a").alias("older"), p("b").alias("newer")).withColumn("d", F.round(F.col("older") - F.col("newer"), 6)), "pairs")


def _interval_sql(units: str, d: str) -> str:
    return f"""m as (select draw, sum(w * {d}) / sum(w) as stat from {drawn_sql(units, 'id')} group by draw), e as (select round(quantile_cont(stat, 0.025), 6) as ci_low, round(quantile_cont(stat, 0.975), 6) as ci_high, count(*) filter (where stat <= 0) as below, count(*) filter (where stat >= 0) as above, count(*)::bigint as draws from m),
r as (select point, ci_low, ci_high, ci_low > 0 or ci_high < 0 as excludes_zero, round(least(1.0, 2.0 * (least(below, above) + 1) / (draws + 1)), 6)::double as p_value, pairs, draws from (select round(avg({d}), 6) as point, count(*)::bigint as pairs from {units}), e)"""


@query(f"with {PAIRS}, {_interval_sql('pairs', 'd')} select * from r")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """R02."""
    return resample.paired_bootstrap(_pairs(spark, d), "id", "d", DRAWS, SEED)


@query(f"with {PAIRS}, {_interval_sql('pairs', 'd')} select *, {BAND}::double as band, ci_low > -{BAND} and ci_high < {BAND} as passed from r")
def equivalence_test(spark: SparkSession, d: str) -> DataFrame:
    """R04."""
    return resample.equivalence(paired_bootstrap(spark, d), BAND)


DIRECTION = "case when not excludes_zero then 'inconclusive' when point > 0 then 'prefers older' else 'prefers newer' end"


@query(f"with {PAIRS}, {_interval_sql('pairs', 'd')} select r.*, round((select avg(older) from pairs), 6) as mean_older, round((select avg(newer) from pairs), 6) as mean_newer, {DIRECTION} as direction from r")
def probe_estimate(spark: SparkSession, d: str) -> DataFrame:
    """A scorer asked for both sides of each pair."""
    return resample.probe(_pairs(spark, d), "id", "older", "newer", DRAWS, SEED)


FLIP = f"flipped as (select id, case when {uniform_sql('0', 'id')} < 0.5 then -d else d end as d from pairs)"


@query(f"""with {PAIRS}, {FLIP}, p as (with {_interval_sql('pairs', 'd')} select * from r), c as (with {_interval_sql('flipped', 'd')} select * from r)
select p.point as delta, p.ci_low, p.ci_high, c.point as control, c.ci_low as control_low, c.ci_high as control_high, c.ci_low > -{BAND} and c.ci_high < {BAND} as reportable, p.pairs < 300 as underpowered from p, c""")
def probe_run(spark: SparkSession, d: str) -> DataFrame:
    """The estimate, the same over pairs whose sides are exchanged by chance, and whether that control lets it be reported."""
    pairs = _pairs(spark, d)
    both = pairs.withColumn("flipped", F.when(resample.uniform(SEED, F.lit(0), F.col("id")) < 0.5, -F.col("d")).otherwise(F.col("d")))
    primary, control = resample.paired_bootstraps(both, "id", ["d", "flipped"], DRAWS, SEED)
    primary = primary.select(F.col("point").alias("delta"), "ci_low", "ci_high", (F.col("pairs") < 300).alias("underpowered"))
    control = resample.equivalence(control, BAND).select(F.col("point").alias("control"), F.col("ci_low").alias("control_low"), F.col("ci_high").alias("control_high"), F.col("passed").alias("reportable"))
    return primary.crossJoin(F.broadcast(control))


def _rank_sql(column: str, name: str) -> str:
    return f"{name} as (select draw, {column} as v, sum(c) over (partition by draw order by {column} rows unbounded preceding) - (c - 1) / 2.0 as r from (select draw, {column}, sum(w) as c from dr group by all))"


def _spearman_sql(units: str, x: str, y: str) -> str:
    return f"""pr as (select x, y, c, dense_rank() over (order by x) - 1 as x_at, dense_rank() over (order by y) - 1 as y_at from (select {x}::double as x, {y}::double as y, count(*) as c from {units} group by all) where x is not null and y is not null),
pc as (select c, list(p order by k) as ps from (select c, k, round(sum(exp(k * ln(c) - c - lgamma(k + 1))) over (partition by c order by k rows unbounded preceding), 12) as p from (select c, unnest(generate_series(0, ceil(c + 12 * sqrt(c) + 20)::int)) as k from (select distinct c from pr))) group by c),
dr as (select * from (select draw, x_at, y_at, case when c = 1 then {weight_sql('u')} else len(list_filter(ps, lambda p: u >= p)) end as w
 from (select * exclude (h, b, j), b * {resample.SHARE} + j + 1 as draw, (('0x' || substr(h, 7 * j + 1, 7))::int / 268435456.0)::double as u from (select pr.*, ps, b, md5('{SEED}:' || b || ':' || x_at || ':' || y_at) as h from pr join pc using (c), generate_series(0, {-(-DRAWS // resample.SHARE) - 1}) g(b)), generate_series(0, {resample.SHARE - 1}) k(j)) where draw <= {DRAWS}) where w > 0),
{_rank_sql('x_at', 'rx')}, {_rank_sql('y_at', 'ry')}, z as (select dr.draw, sum(w) as n, sum(w * rx.r) as sa, sum(w * ry.r) as sb, sum(w * rx.r * ry.r) as sab, sum(w * rx.r * rx.r) as saa, sum(w * ry.r * ry.r) as sbb from dr join rx on rx.draw = dr.draw and rx.v = dr.x_at join ry on ry.draw = dr.draw and ry.v = dr.y_at group by dr.draw),
rho as (select (sab - sa * sb / n) / sqrt((saa - sa * sa / n) * (sbb - sb * sb / n)) as stat from z where n >= 3 and saa - sa * sa / n > 1e-9 and sbb - sb * sb / n > 1e-9)"""


@query(f"with {CAND}, {SHEET}, ju as (select event_id as id, support as x, label as y from sheet join adm using (event_id)), {_spearman_sql('ju', 'x', 'y')} select round(quantile_cont(stat, 0.025), 6) as ci_low, round(quantile_cont(stat, 0.975), 6) as ci_high, count(*)::bigint as draws from rho")
def bootstrap_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of a score with judgements, resampled."""
    return resample.bootstrap_spearman(_judged(spark, d), "support", "label", DRAWS, SEED)


def _rate_sql(name: str, test: str) -> str:
    return f"{name}_u as (select user_id as id, sum(({test})::int) as s, count(*) as c from adm group by user_id), {name}_m as (select draw, sum(w * s) / sum(w * c) as stat from {drawn_sql(name + '_u', 'id')} group by draw)"


def _rate_row(name: str) -> str:
    return f"select '{name}' as statistic, round((select sum(s) / sum(c) from {name}_u), 6)::double as rate, (select count(*) from {name}_u)::bigint as clusters, (select round(quantile_cont(stat, 0.025), 6) from {name}_m) as ci_low, (select round(quantile_cont(stat, 0.975), 6) from {name}_m) as ci_high"


ARMS = {"first": "admitted", "second": "support >= 0.5", "either": "admitted or support >= 0.5"}


@query(f"with {CAND}, " + ", ".join(_rate_sql(k, v) for k, v in ARMS.items()) + ", t as (" + " union all ".join(_rate_row(k) for k in ARMS) + "), k as (select count(*) filter (where admitted and support >= 0.5)::bigint as both_arms, count(*) filter (where admitted and support < 0.5)::bigint as only_first, count(*) filter (where not admitted and support >= 0.5)::bigint as only_second, round(2 * asin(sqrt(avg(admitted::int))) - 2 * asin(sqrt(avg((support >= 0.5)::int))), 9) as h from adm) select * from t, k")
def admission_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Rates of both arms and of either with clustered intervals, their two-by-two table and effect size."""
    rows = write_once(decisions(spark, d).select("user_id", "admitted", (F.col("support") >= 0.5).alias("second")), "arms")
    tests = {"first": F.col("admitted"), "second": F.col("second"), "either": F.col("admitted") | F.col("second")}
    rates = resample.cluster_rates(rows, "user_id", {n: t.cast("int") for n, t in tests.items()}, DRAWS, SEED)
    parts = [r.select(F.lit(n).alias("statistic"), "rate", "clusters", "ci_low", "ci_high") for n, r in zip(tests, rates, strict=True)]
    square = compare.contingency(rows, "admitted", "second").select(F.col("both").alias("both_arms"), F.col("only_a").alias("only_first"), F.col("only_b").alias("only_second"))
    h, _ = stats.cohens_h(F.col("pa"), F.col("pb"))
    rates = rows.agg(F.avg(F.col("admitted").cast("int")).alias("pa"), F.avg(F.col("second").cast("int")).alias("pb")).select(h.alias("h"))
    return parts[0].union(parts[1]).union(parts[2]).crossJoin(F.broadcast(square.crossJoin(F.broadcast(rates))))


SCORES = ["support", "currency", "authority"]


@query(f"with {CAND}, {SHEET}, ju as (select event_id as id, {', '.join(s + '::double as ' + s for s in SCORES)}, label as y from sheet join adm using (event_id)), " + ", ".join(f"{s}_i as (with {_spearman_sql('ju', s, 'y')} select '{s}' as score, round(quantile_cont(stat, 0.025), 6) as ci_low, round(quantile_cont(stat, 0.975), 6) as ci_high, count(*)::bigint as draws from rho)" for s in SCORES) + ", a as (" + " union all ".join(f"select * from {s}_i" for s in SCORES) + "), w as (select *, round(abs(ci_high + ci_low), 6) as width, row_number() over (order by round(abs(ci_high + ci_low), 6), score)::int as place from a) select score, ci_low, ci_high, draws, place, (select count(*) from ju)::bigint as judged from w")
def evidence_quality_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Judgements joined with decisions, a resampled rank correlation for each score, in the order of how far they are from none."""
    from pyspark.sql import Window

    judged = write_once(_judged(spark, d).select(*SCORES, "label"), "judged")
    parts = None
    for s in SCORES:
        one = resample.bootstrap_spearman(judged, s, "label", DRAWS, SEED).withColumn("score", F.lit(s))
        parts = one if parts is None else parts.union(one)
    order = Window.orderBy(F.round(F.abs(F.col("ci_high") + F.col("ci_low")), 6), "score")
    n = judged.agg(F.count(F.lit(1)).alias("judged"))
    return parts.withColumn("place", F.row_number().over(order)).crossJoin(F.broadcast(n)).select("score", "ci_low", "ci_high", "draws", "place", "judged")


@query(f"""with {CAND}, {_rate_sql('a', 'admitted')}, e as (select round(quantile_cont(stat, 0.025), 6) as ci_low, round(quantile_cont(stat, 0.975), 6) as ci_high, count(*) filter (where stat <= 0) as below, count(*) filter (where stat >= 0) as above, count(*)::bigint as draws from a_m)
select round((select sum(s) / sum(c) from a_u), 6)::double as rate, (select count(*) from a_u)::bigint as clusters, ci_low, ci_high, ci_low > 0 or ci_high < 0 as excludes_zero, round(least(1.0, 2.0 * (least(below, above) + 1) / (draws + 1)), 6)::double as p_value, draws from e""")
def cluster_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """The admission rate with the interval of 10,000 resamples of whole questions and its test against 0."""
    return resample.cluster_rate(decisions(spark, d), "user_id", F.col("admitted").cast("int"), DRAWS, SEED)
