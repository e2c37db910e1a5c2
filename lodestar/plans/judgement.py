"""Queries over human judgements: `labels` are the sheets, `events` the decisions they judge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalog import query, table
from lodestar.functions import text as X
from lodestar.operators import compare, judge, select
from lodestar.plans.corpus import CHUNKS, T1, _chunks
from lodestar.plans.evidence import CAND, decisions

TERMS = ["support", "currency", "rerank", "authority"]
SHEET = "sheet as (select doc_id as event_id, max(quality + toxic)::int as label from labels group by doc_id)"


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """A sheet of judgements (0, 1, 2) of decisions."""
    return table(spark, d, "labels").groupBy(F.col("doc_id").alias("event_id")).agg(F.max(F.col("quality") + F.col("toxic")).cast("int").alias("label"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return _sheet(spark, d).join(decisions(spark, d), "event_id")


@query(f"with {CAND}, {SHEET}, a as (select case when event_id % 7 = 0 then -event_id - 1 else event_id end as event_id, label from sheet) select a.event_id, label, admitted, adm.event_id is not null as matched from a left join adm using (event_id)")
def annotated_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Annotations that match no decision are listed, not dropped."""
    rows = _sheet(spark, d).withColumn("event_id", F.when(F.col("event_id") % 7 == 0, -F.col("event_id") - 1).otherwise(F.col("event_id")))
    return judge.resolved(rows, decisions(spark, d).select("event_id", "admitted"), ["event_id"]).select("event_id", "label", "admitted", "matched")


@query(f"with {SHEET}, b as (select event_id, (label + event_id % 3)::int as label from sheet) select event_id, sheet.label as label_1, b.label as label_2, b.label - sheet.label as change from sheet join b using (event_id) where sheet.label in (0, 1, 2) and b.label in (0, 1, 2)")
def pass_comparison(spark: SparkSession, d: str) -> DataFrame:
    """J14."""
    first = _sheet(spark, d)
    second = first.withColumn("label", (F.col("label") + F.col("event_id") % 3).cast("int"))
    return judge.pass_comparison(first, second, "event_id", "label", [0, 1, 2])


@query("with a as (select o_orderkey as id, row_number() over (order by o_orderkey) - 1 as position from orders where o_orderkey % 50 <> 7), b as (select o_orderkey as id, row_number() over (order by o_orderkey) - 1 as position from orders where o_orderkey % 50 <> 9) select position, a.id as left_id, b.id as right_id, a.id is not distinct from b.id as agree from a full join b using (position)")
def positional_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The i-th id of an index against row i of its manifest."""
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return select.aligned(o.where("id % 50 <> 7"), o.where("id % 50 <> 9"), "id")


@query("""with r as (select doc_id, source is null or n_chars < 900 as no_title, n_chars < 1500 as no_body, lang = 'en' and n_chars < 2000 as no_links from documents), x as (select page_id as doc_id, html like '%<title>%' as title, html like '%<p>%' as body, html like '%href=%' as links from pages)
select doc_id, c as contradiction from (select doc_id, unnest(list_filter([case when no_title and title then 'title' end, case when no_body and body then 'body' end, case when no_links and links then 'links' end], lambda q: q is not null)) as c from r join x using (doc_id))""")
def label_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """What a record says is absent and its source plainly carries."""
    record = table(spark, d, "documents").select("doc_id", (F.col("source").isNull() | (F.col("n_chars") < 900)).alias("no_title"), (F.col("n_chars") < 1500).alias("no_body"), ((F.col("lang") == "en") & (F.col("n_chars") < 2000)).alias("no_links"))
    probe = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.contains("html", F.lit("<title>")).alias("title"), F.contains("html", F.lit("<p>")).alias("body"), F.contains("html", F.lit("href=")).alias("links"))
    found = F.filter(F.array(*[F.when(F.col(f"no_{k}") & F.col(k), F.lit(k)) for k in ("title", "body", "links")]), lambda x: x.isNotNull())
    return record.join(probe, "doc_id").select("doc_id", F.explode(found).alias("contradiction"))


@query(f"with {CAND}, m as (select event_type, event_id from adm where published is null qualify row_number() over (partition by event_type order by event_id) <= 5), e as (select event_type, string_agg(event_id::varchar, ',' order by event_id) as examples from m group by event_type) select event_type, count(published)::bigint as dated, (count(*) - count(published))::bigint as undated, coalesce(any_value(examples), '') as examples from adm left join e using (event_type) group by event_type")
def completeness_census(spark: SparkSession, d: str) -> DataFrame:
    """A10."""
    return judge.census(decisions(spark, d), ["event_type"], F.col("published").isNotNull(), "event_id")


@query(f"""with b as (select item_id, list_distinct({T1}) as q from benchmark), c as (select conv_id, role, list_distinct({T1}) as t from conversations where text is not null), p as (select role, case when len(q) + len(t) = 0 then 0.0 else len(list_intersect(q, t)) / (len(q) + len(t) - len(list_intersect(q, t))) end as j from c join b on b.item_id = c.conv_id % 20)
select role, count(*)::bigint as n, round(avg(j), 9) as mean, round(min(j), 9) as low, round(max(j), 9) as high from p group by role""")
def overlap_by_role(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard of question and evidence for each role."""
    q = table(spark, d, "benchmark").select("item_id", F.array_distinct(X.policy_tokens(F.col("text"))).alias("q"))
    c = table(spark, d, "conversations").where("text is not null").select((F.col("conv_id") % 20).alias("item_id"), "role", F.array_distinct(X.policy_tokens(F.col("text"))).alias("t"))
    both = F.size(F.array_intersect("q", "t"))
    j = F.coalesce(F.try_divide(both.cast("double"), (F.size("q") + F.size("t") - both).cast("double")), F.lit(0.0))
    rows = c.join(q, "item_id").select("role", j.alias("j"))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("j"), 9).alias("mean"), F.round(F.min("j"), 9).alias("low"), F.round(F.max("j"), 9).alias("high"))


@query(f"with {CAND}, s as (select admitted as before, not retracted and score >= 0.6 as now from adm) select count(*) filter (where now <> before)::bigint as changed, count(*) filter (where now and not before)::bigint as newly_admitted, count(*) filter (where not now and before)::bigint as newly_rejected, count(*) filter (where now = before)::bigint as unchanged from s")
def agreement_with_run(spark: SparkSession, d: str) -> DataFrame:
    """A22."""
    rows = decisions(spark, d).withColumn("now", ~F.col("retracted") & (F.col("score") >= 0.6))
    return judge.agreement(rows, "now", "admitted")


@query(f"with {CAND}, {SHEET}, s as (select user_id, count(*) as s from sheet join adm using (event_id) group by user_id) select coalesce(sum(s), 0)::bigint as rows, count(*)::bigint as clusters, coalesce(min(s), 0)::bigint as smallest, coalesce(max(s), 0)::bigint as largest, round(avg(s), 4) as mean from s")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A26."""
    return judge.clusters(_judged(spark, d), "user_id")


GROUPS = {"all": "true", "first_admitted": "a", "first_rejected": "not a", "second_admitted": "b", "second_rejected": "not b", "first_only": "a and not b", "second_only": "b and not a", "both": "a and b", "neither": "not a and not b"}


@query(f"with {CAND}, {SHEET}, j as (select label, admitted as a, support >= 0.5 as b from sheet join adm using (event_id)) " + " union all ".join(f"select '{k}' as \"group\", count(label)::bigint as n, round(avg(label), 9) as mean, min(label) as low, max(label) as high from j where {v} having count(*) > 0" for k, v in GROUPS.items()))
def overlapping_groups(spark: SparkSession, d: str) -> DataFrame:
    """Judged quality of nine groups that overlap."""
    rows = _judged(spark, d).withColumns({"a": F.col("admitted"), "b": F.col("support") >= 0.5})
    return judge.overlapping_groups(rows, {k: F.expr(v) for k, v in GROUPS.items()}, "label")


@query(f"with {CAND}, u as (" + " union all ".join(f"select '{t}' as term, {t}::double as v, admitted from adm" for t in TERMS) + ") select term, count(distinct v)::bigint as distinct_values, min(v) as low, max(v) as high, round(avg(v) filter (where admitted), 6) as mean_admitted, round(avg(v) filter (where not admitted), 6) as mean_rejected, round(avg(v) filter (where admitted) - avg(v) filter (where not admitted), 6) as difference, round(median(v), 6) as median from u group by term")
def term_discrimination(spark: SparkSession, d: str) -> DataFrame:
    """A30."""
    return judge.discrimination(decisions(spark, d), TERMS, "admitted")


@query(f"""with {CAND}, a as (select user_id, event_id from adm qualify row_number() over (partition by user_id order by score desc, event_id) <= 5), b as (select user_id, event_id from adm qualify row_number() over (partition by user_id order by support desc, event_id) <= 5),
o as (select user_id, count(*) filter (where n = 2) as "both" from (select user_id, event_id, count(*) as n from (select * from a union all select * from b) group by all) group by user_id) select "both", count(*)::bigint as questions from o group by "both\"""")
def overlap_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How far two rankings' own top five agree."""
    return judge.overlap_histogram(compare.matched_k(decisions(spark, d), "user_id", "event_id", "score", "support", 5), "both")


VARIANTS = [("support_only", 1.0, 0.0, 0.0), ("support_currency", 0.5, 0.3, 0.0), ("support_authority", 0.5, 0.0, 0.2), ("full", 0.5, 0.3, 0.2)]


@query(f"with {CAND}, v(variant, ws, wc, wa) as (values {', '.join(map(str, VARIANTS))}) select variant, count(*) filter (where round(ws * support + wc * currency + wa * authority, 12) >= 0.45)::bigint as admitted, count(*)::bigint as candidates, round(any_value(ws + wc + wa), 4)::double as max_possible from adm, v group by variant")
def component_grid(spark: SparkSession, d: str) -> DataFrame:
    """A43."""
    variants = spark.createDataFrame(VARIANTS, "variant string, w_support double, w_currency double, w_authority double")
    return judge.component_grid(decisions(spark, d), variants, ["support", "currency", "authority"], 0.45)


@query(f"with {CAND} select case when retracted then 'retracted' when published is null then 'undated' when score < 0.45 then 'below_threshold' else 'kept' end as reason, count(*)::bigint as n from adm group by reason")
def exclusion_counters(spark: SparkSession, d: str) -> DataFrame:
    """A42."""
    reasons = {"retracted": F.col("retracted"), "undated": F.col("published").isNull(), "below_threshold": F.col("score") < 0.45}
    return judge.counters(decisions(spark, d), reasons)


@query(f"with {CHUNKS} select doc_id, max(round(word_count / (word_count + 10.0 * (chunk_index + 1)), 9)) as score, count(*)::bigint as windows from chunks group by doc_id")
def max_over_windows(spark: SparkSession, d: str) -> DataFrame:
    """A document's score is that of its best window."""
    rows = _chunks(spark, d).select("doc_id", F.round(F.col("word_count") / (F.col("word_count") + 10.0 * (F.col("chunk_index") + 1)), 9).alias("score"))
    return judge.max_over_windows(rows, "doc_id", "score")


@query("select event_id, round(1 / (1 + exp((user_id % 7 - 3) - value / 50)), 9) as p from events where abs(value) < 10000")
def two_way_softmax(spark: SparkSession, d: str) -> DataFrame:
    """M12."""
    rows = table(spark, d, "events").where(F.abs("value") < 10000)
    return rows.select("event_id", F.round(judge.two_way_softmax(F.col("value") / 50, (F.col("user_id") % 7 - 3).cast("double")), 9).alias("p"))


def _status(checks: list[tuple[str, str, str]]) -> str:
    return " union all ".join(f"select '{name}' as \"check\", case when n = 0 then 'PASS' else '{word}' end as status, n::varchar as detail from (select coalesce({sql}, 0)::bigint as n from j)" for name, sql, word in checks)


@query(f"""with {CAND}, {SHEET}, j as (select s.event_id, s.label, a.event_id as real, a.event_type, a.value, case when s.event_id % 5 <> 0 then (s.label * (1 - (s.event_id % 3 = 0)::int))::int end as hint, s.event_id % 4 = 0 as shown from sheet s left join adm a using (event_id))
{_status([("labels_present", "count(*) filter (where label is null)", "FAIL"), ("labels_valid", "count(*) filter (where label not in (0, 1, 2))", "FAIL"), ("ids_unique", "count(*) - count(distinct event_id)", "FAIL"), ("rows_are_decisions", "count(*) filter (where real is null)", "FAIL"), ("text_present", "count(*) filter (where real is not null and trim(coalesce(event_type, '''')) = '''')".replace("''''", "''"), "FAIL"), ("no_training_rows", "count(*) filter (where event_id < 0)", "FAIL")])}
union all select 'label_not_copied', case when count(*) filter (where hint is not null) = 0 or count(*) filter (where label <> hint) > 0 then 'PASS' when count(*) filter (where hint is not null and not shown) = 0 then 'FAIL' else 'WARN' end, (count(*) filter (where label <> hint))::varchar || '/' || (count(*) filter (where hint is not null))::varchar from j""")
def annotation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Q08: labels present, valid, unique, of real decisions, with text, without training rows, and not copied from a hint."""
    real = decisions(spark, d).select("event_id", F.col("event_id").alias("real"), "event_type")
    rows = _sheet(spark, d).join(real, "event_id", "left")
    base = judge.findings(rows, {
        "labels_present": F.count_if(F.col("label").isNull()), "labels_valid": F.count_if(~F.col("label").isin(0, 1, 2)), "ids_unique": F.count(F.lit(1)) - F.count_distinct("event_id"),
        "rows_are_decisions": F.count_if(F.col("real").isNull()), "text_present": F.count_if(F.col("real").isNotNull() & (F.trim(F.coalesce("event_type", F.lit(""))) == "")), "no_training_rows": F.count_if(F.col("event_id") < 0),
    })
    hint = F.when(F.col("event_id") % 5 != 0, F.col("label") * (1 - (F.col("event_id") % 3 == 0).cast("int")))
    return base.union(judge.copied_labels(rows, F.col("label"), hint, F.col("event_id") % 4 == 0))


@query(f"""with {SHEET}, b as (select event_id, label, event_id % 10 = 3 as hinted from sheet where event_id % 40 <> 5), j as (select s.event_id as old, b.event_id as new, s.label as l1, b.label as l2, b.hinted from sheet s full join b using (event_id))
{_status([("no_rows_missing", "count(*) filter (where new is null)", "FAIL"), ("no_rows_added", "count(*) filter (where old is null)", "FAIL"), ("labels_unchanged", "count(*) filter (where l1 <> l2)", "FAIL"), ("no_hint_shown", "count(*) filter (where hinted)", "FAIL"), ("marked_as_corrected", "count(*) filter (where new is not null and hinted is null)", "WARN")])}""")
def corrected_pass_audit(spark: SparkSession, d: str) -> DataFrame:
    """Q09: the second pass holds the first one's rows, and saw no hint."""
    first = _sheet(spark, d).select("event_id", F.col("event_id").alias("old"), F.col("label").alias("l1"))
    second = _sheet(spark, d).where("event_id % 40 <> 5").select("event_id", F.col("event_id").alias("new"), F.col("label").alias("l2"), (F.col("event_id") % 10 == 3).alias("hinted"))
    rules = {
        "no_rows_missing": F.count_if(F.col("new").isNull()), "no_rows_added": F.count_if(F.col("old").isNull()), "labels_unchanged": F.count_if(F.col("l1") != F.col("l2")),
        "no_hint_shown": F.count_if("hinted"), "marked_as_corrected": F.count_if(F.col("new").isNotNull() & F.col("hinted").isNull()),
    }
    return judge.findings(first.join(second, "event_id", "full"), rules, frozenset({"marked_as_corrected"}))


@query(f"""with {CAND}, q as (select user_id, count(*) as n, count(distinct event_id) as ids, count(*) filter (where rank > depth) as beyond, max(rank) as last from adm group by user_id), t as (select user_id, event_id from adm qualify row_number() over (partition by user_id order by score desc, event_id) <= 3), j as (select q.*, (select count(*) from t where t.user_id = q.user_id) as k from q)
{_status([("same_candidates", "count(*) filter (where n <> 20)", "FAIL"), ("enough_for_k", "count(*) filter (where n < 3)", "FAIL"), ("k_sizes", "count(*) filter (where k <> least(3, n))", "FAIL"), ("no_duplicates", "sum(n - ids)", "FAIL"), ("own_candidates_only", "sum(beyond)", "FAIL"), ("ranks_complete", "count(*) filter (where last <> n)", "FAIL")])}""")
def matched_k_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Q07: sizes of candidate sets and of selections; selections are unique and from the question's own candidates."""
    rows = decisions(spark, d)
    per = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"), F.count_if(F.col("rank") > F.col("depth")).alias("beyond"), F.max("rank").alias("last"))
    from lodestar.operators import retrieve

    chosen = retrieve.top(rows, ["user_id"], [F.desc("score"), F.col("event_id")], 3, "place").groupBy("user_id").agg(F.count(F.lit(1)).alias("k"))
    n = F.col("n")
    return judge.findings(per.join(chosen, "user_id"), {
        "same_candidates": F.count_if(n != 20), "enough_for_k": F.count_if(n < 3), "k_sizes": F.count_if(F.col("k") != F.least(F.lit(3), n)),
        "no_duplicates": F.sum(n - F.col("ids")), "own_candidates_only": F.sum("beyond"), "ranks_complete": F.count_if(F.col("last") != n),
    })


@query(f"""with {CAND}, j as (select * from adm)
{_status([("questions_have_candidates", "any_value((select count(*) from (select distinct user_id from events) u where user_id not in (select user_id from adm)))", "FAIL"), ("ids_unique", "count(*) - count(distinct event_id)", "FAIL"), ("text_present", "count(*) filter (where trim(coalesce(event_type, '')) = '')", "FAIL"), ("score_present", "count(*) filter (where value is null)", "FAIL"), ("scores_finite", "count(*) filter (where isnan(value) or isinf(value))", "FAIL"), ("dates_present", "count(*) filter (where published is null)", "FAIL")])}""")
def frozen_set_validation(spark: SparkSession, d: str) -> DataFrame:
    """Q04: what would make a frozen candidate set unusable, as rows."""
    rows = decisions(spark, d)
    value = F.col("value")
    lone = table(spark, d, "events").select("user_id").distinct().join(rows, "user_id", "left_anti").agg(F.count(F.lit(1)).alias("lone"))
    found = judge.findings(rows.crossJoin(F.broadcast(lone)), {
        "questions_have_candidates": F.max("lone"), "ids_unique": F.count(F.lit(1)) - F.count_distinct("event_id"), "text_present": F.count_if(F.trim(F.coalesce("event_type", F.lit(""))) == ""),
        "score_present": F.count_if(value.isNull()), "scores_finite": F.count_if(F.isnan(value) | (F.abs(value) == float("inf"))), "dates_present": F.count_if(F.col("published").isNull()),
    })
    return found


POLICY = "pol as (select doc_id, max(quality) as policy, max(toxic) as banned from labels group by doc_id)"


@query(f"""with {CHUNKS}, {POLICY}, j as (select c.chunk_id, c.doc_id, c.text, c.text_sha256, c.source, d.source as owner, pol.doc_id as known, pol.banned, d.n_chars from chunks c left join documents d using (doc_id) left join pol using (doc_id))
{_status([("chunks_read", "(count(*) = 0)::int", "FAIL"), ("unique_chunk_ids", "count(*) - count(distinct chunk_id)", "FAIL"), ("chunk_belongs_to_document", "count(*) filter (where not starts_with(chunk_id, doc_id::varchar || '#'))", "FAIL"), ("no_orphans", "count(*) filter (where known is null)", "FAIL"), ("one_identity", "any_value((select count(*) from (select doc_id from chunks group by doc_id having count(distinct coalesce(source, '') || '|' || coalesce(lang, '')) > 1)))", "FAIL"), ("provenance_complete", "count(*) filter (where trim(coalesce(text, '')) = '' or coalesce(source, '') = '' or text_sha256 is null)", "FAIL"), ("size_preserved", "count(*) filter (where n_chars is null)", "FAIL"), ("size_positive", "count(*) filter (where n_chars <= 0)", "FAIL"), ("source_preserved", "count(*) filter (where source is distinct from owner)", "FAIL"), ("no_excluded", "count(*) filter (where banned = 1)", "FAIL"), ("digest_of_text", "count(*) filter (where text_sha256 <> sha256(text))", "FAIL"), ("words_bounded", "count(*) filter (where length(text) > 100000)", "FAIL")])}""")
def chunk_layer_validation(spark: SparkSession, d: str) -> DataFrame:
    """Q01: twelve checks of the chunk layer in one pass over the chunks."""
    policy = table(spark, d, "labels").groupBy(F.col("doc_id").alias("known")).agg(F.max("toxic").alias("banned"))
    owner = table(spark, d, "documents").select(F.col("doc_id").alias("o"), F.col("source").alias("owner"), "n_chars")
    rows = _chunks(spark, d).join(owner, F.col("doc_id") == F.col("o"), "left").join(policy, F.col("doc_id") == F.col("known"), "left")
    several = _chunks(spark, d).groupBy("doc_id", F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("i")).agg(F.lit(1).alias("x")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("several"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return judge.findings(rows.crossJoin(F.broadcast(several)), {
        "chunks_read": (F.count(F.lit(1)) == 0).cast("int"), "unique_chunk_ids": F.count(F.lit(1)) - F.count_distinct("chunk_id"),
        "chunk_belongs_to_document": F.count_if(~F.startswith("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("#")))), "no_orphans": F.count_if(F.col("known").isNull()), "one_identity": F.max("several"),
        "provenance_complete": F.count_if(blank("text") | (F.coalesce("source", F.lit("")) == "") | F.col("text_sha256").isNull()), "size_preserved": F.count_if(F.col("n_chars").isNull()), "size_positive": F.count_if(F.col("n_chars") <= 0),
        "source_preserved": F.count_if(~F.col("source").eqNullSafe(F.col("owner"))), "no_excluded": F.count_if(F.col("banned") == 1), "digest_of_text": F.count_if(F.col("text_sha256") != F.sha2("text", 256)), "words_bounded": F.count_if(F.length("text") > 100000),
    })


@query("""with a as (select doc_id, source, n_chars from documents), b as (select doc_id, source, case when doc_id % 31 = 4 then n_chars + 1 else n_chars end as n_chars from documents where doc_id % 90 <> 8), q as (select doc_id from labels),
j as (select a.doc_id as left_id, b.doc_id as right_id, a.source as s1, b.source as s2, a.n_chars as n1, b.n_chars as n2 from a full join b using (doc_id))
""" + _status([("unique_ids", "count(left_id) - count(distinct left_id)", "FAIL"), ("nothing_lost", "count(*) filter (where right_id is null)", "FAIL"), ("nothing_added", "count(*) filter (where left_id is null)", "FAIL"), ("source_equal", "count(*) filter (where s1 <> s2)", "FAIL"), ("size_equal", "count(*) filter (where n1 <> n2)", "FAIL"), ("provenance_known", "any_value((select count(*) from q where doc_id not in (select doc_id from documents)))", "FAIL"), ("size_in_window", "count(*) filter (where n1 not between 0 and 200000)", "FAIL")]))
def acquisition_verification(spark: SparkSession, d: str) -> DataFrame:
    """Q03: two outputs of one acquisition, field for field, and provenance in both directions."""
    docs = table(spark, d, "documents")
    a = docs.select("doc_id", F.col("doc_id").alias("left_id"), F.col("source").alias("s1"), F.col("n_chars").alias("n1"))
    b = docs.where("doc_id % 90 <> 8").select("doc_id", F.col("doc_id").alias("right_id"), F.col("source").alias("s2"), F.when(F.col("doc_id") % 31 == 4, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n2"))
    orphans = table(spark, d, "labels").join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return judge.findings(a.join(b, "doc_id", "full").crossJoin(F.broadcast(orphans)), {
        "unique_ids": F.count("left_id") - F.count_distinct("left_id"), "nothing_lost": F.count_if(F.col("right_id").isNull()), "nothing_added": F.count_if(F.col("left_id").isNull()),
        "source_equal": F.count_if(F.col("s1") != F.col("s2")), "size_equal": F.count_if(F.col("n1") != F.col("n2")), "provenance_known": F.max("orphans"), "size_in_window": F.count_if(~F.col("n1").between(0, 200000)),
    })


READY = "case when gold > 0 and scored > 0 then 'READY' when gold > 0 or scored > 0 then 'PARTIAL' else 'NOT READY' end"


@query(f"select source, gold, scored, {READY} as decision from (select source, count(quality)::bigint as gold, count(*) filter (where toxic = 1)::bigint as scored from documents left join labels using (doc_id) group by source)")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    """Q15: whether answer quality can be measured at all, for each question set."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count("quality").alias("gold"), F.count_if(F.col("toxic") == 1).alias("scored"))
    return rows.withColumn("decision", F.expr(READY))


@query("""with c as (select count(distinct source) as sources, count(*) filter (where lang is null) as undated, count(*) as n from documents) select 'enough_questions' as "check", (select count(*) from benchmark) >= 20 as pass, (select count(*) from benchmark)::varchar as detail union all select 'weights_active', true, '3' union all select 'dates_complete', undated = 0, undated::varchar from c union all select 'sources_present', sources > 0, sources::varchar from c""")
def scientific_preconditions(spark: SparkSession, d: str) -> DataFrame:
    """Q06: what must hold before a run counts; configuration checks on the driver, data checks in one pass."""
    weights = {"support": 0.5, "currency": 0.3, "rerank": 0.0, "authority": 0.2}
    active = sum(w > 0 for w in weights.values())
    docs = table(spark, d, "documents").agg(F.count_distinct("source").alias("sources"), F.count_if(F.col("lang").isNull()).alias("undated"))
    asked = table(spark, d, "benchmark").agg(F.count(F.lit(1)).alias("asked"))
    row = lambda name, ok, detail: F.struct(F.lit(name).alias("check"), ok.alias("pass"), detail.cast("string").alias("detail"))
    rows = F.array(row("enough_questions", F.col("asked") >= 20, F.col("asked")), row("weights_active", F.lit(active >= 2), F.lit(active)), row("dates_complete", F.col("undated") == 0, F.col("undated")), row("sources_present", F.col("sources") > 0, F.col("sources")))
    return docs.crossJoin(F.broadcast(asked)).select(F.explode(rows).alias("r")).select("r.*")


@query(f"""with g as (select doc_id, unnest(['stub', 'no_lang', 'junk']) as grp, [n_chars < 1500, lang is null, regexp_matches(text, '[#*%&$]{{2}}')] as f from documents), m as (select doc_id, grp from g where (grp = 'stub' and f[1]) or (grp = 'no_lang' and f[2]) or (grp = 'junk' and f[3])),
c as (select m.*, p.html like '%<article>%' as has_body, l.quality from m left join pages p on p.page_id = m.doc_id left join (select doc_id, max(quality) as quality from labels group by doc_id) l on l.doc_id = m.doc_id)
select grp as "group", case when grp = 'stub' and has_body then 'possible' when quality = 0 then 'review' when grp = 'no_lang' then 'unusual' else 'legitimate' end as category, count(*)::bigint as n from c group by all""")
def qc_investigation(spark: SparkSession, d: str) -> DataFrame:
    """Members of each problem group, what their source says, and the category that takes precedence."""
    docs = table(spark, d, "documents")
    tests = {"stub": F.col("n_chars") < 1500, "no_lang": F.col("lang").isNull(), "junk": F.col("text").rlike("[#*%&$]{2}")}
    members = docs.select("doc_id", F.explode(F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())).alias("group"))
    probe = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.contains("html", F.lit("<article>")).alias("has_body"))
    judged = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = members.join(probe, "doc_id", "left").join(judged, "doc_id", "left")
    category = F.when((F.col("group") == "stub") & F.col("has_body"), "possible").when(F.col("quality") == 0, "review").when(F.col("group") == "no_lang", "unusual").otherwise("legitimate")
    return rows.groupBy("group", category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
