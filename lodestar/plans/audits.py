"""Queries of Q10: `events` are the population of decisions, a sheet of 120 is drawn from it, and changes are planted in the sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalog import query, table
from lodestar.operators import audit, integrity
from lodestar.plans.evidence import CAND, decisions
from lodestar.plans.judgement import SHEET, _judged
from lodestar.stored import write_once

SIZE, SEED, QUESTIONS = 120, 42, 100
ARMS = ["score", "support"]
FORCED = "superseded and support = 1.0"
ROW = "concat_ws('|', event_id, user_id, tier, category, state)"

H60 = "('0x' || substr(md5({}), 1, 15))::bigint"
ROW_SQL = "concat_ws('|', event_id, user_id, tier, category, state)"
EDGES = ", ".join(f"{a}_v as (select list_sort(list({a})) as v from adm where {a} is not null)" for a in ARMS) + ", edges as (select " + ", ".join(f"{a}_v.v[(len({a}_v.v) // 3) + 1] as {a}_low, {a}_v.v[(2 * len({a}_v.v) // 3) + 1] as {a}_high" for a in ARMS) + f" from {', '.join(f'{a}_v' for a in ARMS)})"
CELL = " || '/' || ".join(f"case when {a} < {a}_low then 'low' when {a} < {a}_high then 'medium' else 'high' end" for a in ARMS)
DRAWN = f"""{EDGES}, cells as (select adm.*, {CELL} as cell, {FORCED} as f from adm, edges),
turns as (select *, row_number() over (partition by cell order by md5('{SEED}:' || event_id), event_id) as draw from cells where not f qualify draw <= {SIZE}),
taken as (select * exclude (draw), (select count(*) from cells where f) + row_number() over (order by draw, cell, event_id) as place from turns),
again as (select *, row_number() over (order by cell, event_id) as place from cells where f union all select * from taken where place <= {SIZE})"""
#: One drawn row has another question, one forced row is gone, a row that was not drawn stands in its place.
PLANTED = """strangers as (select * from cells where not f and event_id not in (select event_id from again) order by event_id limit 1),
sheet as (select event_id, case when place = (select max(place) from again) then user_id + 1 else user_id end as user_id, tier, category, state, cell from again where place > 1
 union all select event_id, user_id, tier, category, state, cell from strangers)"""


def _population(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).select("event_id", "user_id", "tier", "category", "state", "superseded", *ARMS)


def _planted(population: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A recorded sheet with planted changes, and its record: one edge is off by 0.01 and the forced rows are one too few."""
    again, edges = audit.draw_again(population, ARMS, "event_id", F.expr(FORCED), SIZE, SEED)
    columns = ["event_id", "user_id", "tier", "category", "state", "cell"]
    last = again.agg(F.max("place").alias("_last"))
    kept = again.where("place > 1").crossJoin(F.broadcast(last)).withColumn("user_id", F.when(F.col("place") == F.col("_last"), F.col("user_id") + 1).otherwise(F.col("user_id"))).select(*columns)
    bins = F.concat_ws("/", *[audit.stats.bin_of(F.col(a), F.col(f"{a}_low"), F.col(f"{a}_high")) for a in ARMS])
    cells = population.where(f"not ({FORCED})").crossJoin(F.broadcast(edges)).withColumn("cell", bins)
    stranger = cells.join(again.select("event_id"), "event_id", "left_anti").orderBy("event_id").limit(1).select(*columns)
    record = again.agg(F.count(F.lit(1)).alias("sampled"), (F.count_if("forced") - 1).alias("forced")).crossJoin(F.broadcast(population.agg(F.count(F.lit(1)).alias("population"))))
    record = record.crossJoin(F.broadcast(edges)).withColumn("score_low", F.col("score_low") + 0.01)
    return write_once(kept.union(stranger), "sheet"), write_once(record, "record")


@query(f"""with {CAND}, {DRAWN}, {PLANTED}, differ as (select coalesce(a.event_id, b.event_id) as id, case when b.event_id is null then 'missing' when a.event_id is null then 'added' else 'changed' end as kind
 from again a full join sheet b on a.event_id = b.event_id where a.event_id is null or b.event_id is null or a.user_id <> b.user_id),
n as (select (select count(*) from adm) as population, (select count(*) from sheet) as rows, (select count(*) from again) as drawn, (select count(*) from cells where f) as forced, (select count(distinct user_id) from sheet) as questions, (select count(*) from differ) as differ)
select 'sampling' as audit, c.* from (
 select 'population_size' as "check", 'PASS' as status, population || '/' || population as detail from n
 union all select 'sample_size', case when drawn = rows then 'PASS' else 'FAIL' end, drawn || '/' || rows from n
 union all select 'forced_count', case when forced - 1 = forced then 'PASS' else 'FAIL' end, (forced - 1) || '/' || forced from n
 union all select 'edge:score_low', 'FAIL', 'differs' union all select 'edge:score_high', 'PASS', 'same' union all select 'edge:support_low', 'PASS', 'same' union all select 'edge:support_high', 'PASS', 'same'
 union all select 'sample_reproduces', case when differ = 0 then 'PASS' else 'FAIL' end, differ::varchar from n
 union all select 'spans_questions', case when questions >= {QUESTIONS} then 'PASS' else 'WARN' end, questions::varchar from n
 union all select 'not_self_weighting', 'WARN', forced || '/' || rows from n
 union all select 'row_' || kind, 'FAIL', id::varchar from differ
 union all select 'forced_row_missing', 'FAIL', event_id::varchar from again where f and event_id not in (select event_id from sheet)) c""")
def sampling_audit(spark: SparkSession, d: str) -> DataFrame:
    """Q10: the sample drawn again from the whole population; every planted change is named by a row of its own."""
    population = _population(spark, d)
    sheet, record = _planted(population)
    return audit.sampling(sheet, population, record, ARMS, "event_id", "user_id", F.expr(FORCED), SIZE, SEED, F.expr(ROW), QUESTIONS)


#: The set on this disk has lost one row and one other has another state.
LOCAL = "local as (select event_id, user_id, tier, category, case when event_id = (select min(event_id) from adm) then 'edited' else state end as state from adm where event_id <> (select max(event_id) from adm))"


def _tree(name: str, source: str) -> str:
    levels = [("0", "null::varchar", "null::varchar", "()"), ("1", "tier", "null::varchar", "(tier)"), ("2", "tier", "category", "(tier, category)")]
    hashed = f"(select *, {H60.format(ROW_SQL)} as h from {source})"
    return f"{name} as (" + " union all ".join(f"select {n} as level, {a} as tier, {b} as category, count(*) as n, sum(h) as digest from {hashed} group by grouping sets ({g})" for n, a, b, g in levels) + ")"


@query(f"""with {CAND}, {LOCAL}, {_tree('a', 'adm')}, {_tree('b', 'local')}, differ as (select coalesce(a.level, b.level) as level, coalesce(a.tier, b.tier) as tier, coalesce(a.category, b.category) as category, coalesce(a.n, 0) as na, coalesce(b.n, 0) as nb
 from a full join b on a.level = b.level and a.tier is not distinct from b.tier and a.category is not distinct from b.category where a.digest is distinct from b.digest or a.n is distinct from b.n), n as (select count(*) as n, bool_and(value is not null) as production from adm)
select 'provenance' as audit, c.* from (select 'drawn_from_the_run' as "check", 'PASS' as status, n || '/' || n as detail from n
 union all select 'production_retrieval', case when production then 'PASS' else 'FAIL' end, production::varchar from n
 union all select 'source_folder', 'FAIL', 'development' union all select 'local_set', case when count(*) = 0 then 'PASS' else 'WARN' end, count(*)::varchar from differ
 union all select 'node_differs', 'WARN', concat_ws('/', 'root', tier, category) || ' ' || na || '/' || nb from differ) c""")
def provenance_audit(spark: SparkSession, d: str) -> DataFrame:
    """Q10: the digest of the set that a sample came from, and where in its tree the set on this disk differs."""
    run = decisions(spark, d).select("event_id", "user_id", "tier", "category", "state", "value")
    ends = run.agg(F.min("event_id").alias("_a"), F.max("event_id").alias("_b"))
    local = run.crossJoin(F.broadcast(ends)).where("event_id <> _b").withColumn("state", F.when(F.col("event_id") == F.col("_a"), "edited").otherwise(F.col("state"))).drop("_a", "_b")
    root = audit.digest_tree(run, [], F.expr(ROW))
    return audit.provenance(run, root.select("n", "digest"), local, ["tier", "category"], F.expr(ROW), F.col("value").isNotNull(), F.lit("runs\\development\\per_question.jsonl"), "scientific")


HINT = "case when event_id % 5 <> 0 then (label * (1 - (event_id % 3 = 0)::int))::int end"
SHOWN = "case when event_id % 4 = 0 then true when event_id % 4 = 1 then false end"


@query(f"""with {CAND}, {SHEET}, j as (select label, {HINT} as s, {SHOWN} as v from sheet join adm using (event_id) where label is not null),
n as (select count(s) as n, count(*) filter (where label = s) as same, count(*) filter (where s is not null and v) as shown, count(*) filter (where s is not null and not v) as hidden, count(*) filter (where s is not null and v is null) as unknown, count(*) filter (where label > s) as above, count(*) filter (where label < s) as below from j)
select 'anchoring' as audit, c.* from (select 'visibility_recorded' as "check", case when unknown = 0 then 'PASS' else 'WARN' end as status, concat_ws('/', shown, hidden, unknown) as detail from n
 union all select 'unanchored_subset', case when hidden >= 10 then 'PASS' else 'WARN' end, hidden::varchar from n
 union all select 'distinct_from_suggestion', case when round(same / n, 4) < 0.85 then 'PASS' when round(same / n, 4) < 0.95 then 'WARN' else 'FAIL' end, concat_ws('/', same, n, above, below) from n) c""")
def anchoring_audit(spark: SparkSession, d: str) -> DataFrame:
    """Q10: judgements against the suggestion that annotators saw, by whether it was shown."""
    n, y = F.col("event_id"), F.col("label")
    hint = F.when(n % 5 != 0, y * (1 - (n % 3 == 0).cast("int")))
    shown = F.when(n % 4 == 0, F.lit(True)).when(n % 4 == 1, F.lit(False))
    return audit.anchoring(_judged(spark, d), y, hint, shown, F.lit(None).cast("boolean"))


@query("""with l as (select sale_id as key, count(*) as n, min(shipped_at) as first, min(flag) as f1, max(flag) as f2 from sale_lines group by sale_id), s as (select sale_id as key, count(*) as n, min(status) as status, min(sold_at) as sold, max(sold_at) as sold_last from sales group by sale_id),
j as (select coalesce(l.key, s.key) as key, coalesce(l.n, 0) as ln, coalesce(s.n, 0) as sn, first, f1, f2, status, sold, sold_last from l full join s on l.key is not distinct from s.key)
select key, 'orphan' as kind from j where ln > 0 and sn = 0 union all select key, 'no_lines' from j where sn > 0 and ln = 0 union all select key, 'excluded_leak' from j where status = 'held' and ln > 0 union all select key, 'repeated' from j where sn > 1
union all select key, 'shipped_before_sold' from j where first < sold union all select key, 'conflict' from j where f1 <> f2 union all select key, 'undated' from j where sn > 0 and sold is null""")
def integrity_join(spark: SparkSession, d: str) -> DataFrame:
    """Sales and their lines: orphans, lines of excluded sales, repeats, dates out of order, lines that disagree; each as a row."""
    tables = {
        "lines": (table(spark, d, "sale_lines"), "sale_id", {"shipped": F.col("shipped_at"), "flag": F.col("flag")}),
        "sales": (table(spark, d, "sales"), "sale_id", {"status": F.col("status"), "sold": F.col("sold_at")}),
    }
    lines, sales = F.col("lines_n") > 0, F.col("sales_n") > 0
    return integrity.mismatches(tables, {
        "orphan": lines & ~sales, "no_lines": sales & ~lines, "excluded_leak": (F.col("sales_status_min") == "held") & lines, "repeated": F.col("sales_n") > 1,
        "shipped_before_sold": F.col("lines_shipped_min") < F.col("sales_sold_min"), "conflict": F.col("lines_flag_min") != F.col("lines_flag_max"), "undated": sales & F.col("sales_sold_min").isNull(),
    })
