"""Queries over overlays, registries and logs: the order tables stand for manifests and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalog import query, table
from lodestar.functions import dates
from lodestar.functions import text as X
from lodestar.operators import layers, quality


@query("select o_orderkey, coalesce(c_name, '') as customer, coalesce(n_name, '') as nation, coalesce(r_name, '') as region, coalesce(nullif(trim(c_mktsegment), ''), o_orderpriority, '') as segment from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def metadata_assembly(spark: SparkSession, d: str) -> DataFrame:
    """A chain of left lookups with field-level precedence."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    blank = lambda *cs: F.coalesce(*cs, F.lit(""))
    return rows.select("o_orderkey", blank(F.col("c_name")).alias("customer"), blank(F.col("n_name")).alias("nation"), blank(F.col("r_name")).alias("region"), blank(F.nullif(F.trim("c_mktsegment"), F.lit("")), F.col("o_orderpriority")).alias("segment"))


@query("select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def uncovered_layer_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def uncovered_by_pending(spark: SparkSession, d: str) -> DataFrame:
    """Customers whom no pending order covers."""
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders)")
def wanted_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select p_partkey, count(*)::bigint as disagreements from lineitem join part on l_partkey = p_partkey where round(l_extendedprice / l_quantity, 2) <> round(p_retailprice, 2) group by p_partkey")
def disagreement_join(spark: SparkSession, d: str) -> DataFrame:
    """Both sides present and different."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.where(F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2) != F.round("p_retailprice", 2)).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("disagreements"))


@query("select coalesce(l_suppkey, s_suppkey) as suppkey, l_suppkey is not null as in_left, s_suppkey is not null as in_right from (select distinct l_suppkey from lineitem where l_quantity > 49) l full join (select s_suppkey from supplier where s_acctbal > 0) s on l_suppkey = s_suppkey")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("suppkey"))
    right = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("suppkey"))
    return layers.set_difference(left, right, ["suppkey"])


@query("select l_orderkey, string_agg(distinct l_suppkey::varchar, ';' order by l_suppkey::varchar) as suppliers, count(*)::bigint as rows, bool_or(l_returnflag = 'R') as any_returned, arg_min(l_linestatus, (l_linenumber, l_linestatus)) filter (where trim(l_linestatus) <> '') as first_status from lineitem group by l_orderkey")
def provenance_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Union of sources, first non-blank field, any-ok status, for each key."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ";").alias("suppliers"),
        F.count(F.lit(1)).alias("rows"),
        F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"),
        layers.first_by(F.col("l_linestatus"), F.struct("l_linenumber", "l_linestatus")).alias("first_status"),
    )


FLAGS = """f as (select doc_id, source, lang, quality, toxic, list_filter([case when coalesce(trim(text), '') = '' then 'no_body' end, case when n_chars < 1500 then 'stub' end, case when lang <> 'en' then 'not_english' end, case when toxic = 1 then 'flagged' end, case when quality is null then 'unlabelled' end], lambda x: x is not null) as fl
from documents left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) using (doc_id))"""


@query(f"with {FLAGS} select doc_id, array_to_string(fl, ';') as flags, case when list_contains(fl, 'no_body') then 'excluded' when list_contains(fl, 'flagged') then 'manual-review' when list_contains(fl, 'stub') then 'abstract-only' else 'eligible' end as eligibility, len(fl) = 0 as fulltext from f")
def policy_flags(spark: SparkSession, d: str) -> DataFrame:
    """An ordered list of flags and the eligibility that takes precedence."""
    labels = table(spark, d, "labels").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = table(spark, d, "documents").join(labels, F.col("doc_id") == F.col("_id"), "left")
    tests = {"no_body": F.trim(F.coalesce("text", F.lit(""))) == "", "stub": F.col("n_chars") < 1500, "not_english": F.col("lang") != "en", "flagged": F.col("toxic") == 1, "unlabelled": F.col("quality").isNull()}
    flags = F.filter(F.array(*[F.when(t, k) for k, t in tests.items()]), lambda x: x.isNotNull())
    has = lambda k: F.array_contains("fl", k)
    rows = rows.withColumn("fl", flags)
    return rows.select("doc_id", F.array_join("fl", ";").alias("flags"), F.when(has("no_body"), "excluded").when(has("flagged"), "manual-review").when(has("stub"), "abstract-only").otherwise("eligible").alias("eligibility"), (F.size("fl") == 0).alias("fulltext"))


@query(f"with {FLAGS} select flag, count(*)::bigint as n from (select unnest(fl) as flag from f) group by flag")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    """A count per flag of a multi-valued column."""
    return policy_flags(spark, d).select(F.explode(F.split("flags", ";")).alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


RAW = "p as (select o_orderkey, case when o_orderkey % 4 = 0 then strftime(o_orderdate, '%Y') when o_orderkey % 4 = 1 then strftime(o_orderdate, '%Y-%m') when o_orderkey % 4 = 2 then strftime(o_orderdate, '%Y-%m-%d') else 'n.d.' end as raw from orders)"


def _raw_dates(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format(day, "yyyy")).when(k == 1, F.date_format(day, "yyyy-MM")).when(k == 2, F.date_format(day, "yyyy-MM-dd")).otherwise("n.d.")
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))


@query(f"""with {RAW}, k as (select *, case when regexp_full_match(raw, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then 'day' when regexp_full_match(raw, '\\d{{4}}-\\d{{2}}') then 'month' when regexp_full_match(raw, '\\d{{4}}') then 'year' else '' end as kind from p),
b as (select *, case kind when 'day' then raw::date when 'month' then (raw || '-01')::date when 'year' then (raw || '-01-01')::date end as low from k)
select o_orderkey, kind, low::varchar as low, (case kind when 'day' then low when 'month' then last_day(low) when 'year' then make_date(year(low), 12, 31) end)::varchar as high,
case when kind in ('day', 'month') then case when substr(raw, 1, 7) < '1996-06' then 'pre' else 'post' end when kind = 'year' then case when raw < '1996' then 'pre' when raw > '1996' then 'post' else 'unknown' end else 'unknown' end as split from b""")
def partial_date_ops(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw")
    low, high = dates.bounds(raw)
    kind = dates.precision(raw)
    return _raw_dates(spark, d).select("o_orderkey", kind.alias("kind"), low.cast("string").alias("low"), high.cast("string").alias("high"), dates.split_at(raw, kind, "1996-06").alias("split"))


@query(f"""with {RAW}, y as (select *, try_cast(regexp_extract(raw, '^(\\d{{4}})', 1) as int) as y, try_cast(regexp_extract(raw, '^\\d{{4}}-(\\d{{2}})', 1) as int) as m, try_cast(regexp_extract(raw, '^\\d{{4}}-\\d{{2}}-(\\d{{2}})', 1) as int) as dd from p)
select o_orderkey, case when y between 1500 and 2200 then case when m is null then y + 0.5 else y + ((least(12, greatest(1, m)) - 1) + (least(28, greatest(1, coalesce(dd, 15))) - 1) / 30.0) / 12.0 end end::double as year_fraction from y""")
def year_fraction(spark: SparkSession, d: str) -> DataFrame:
    return _raw_dates(spark, d).select("o_orderkey", dates.year_fraction(F.col("raw")).alias("year_fraction"))


@query("select event_id, json_extract_string(props, '$.' || k) as value, k as key from (select event_id, props, unnest(json_keys(props)) as k from events)")
def props_flatten(spark: SparkSession, d: str) -> DataFrame:
    """A JSON map as one row per key."""
    rows = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return rows.select("event_id", F.explode("m").alias("key", "value"))


@query("select event_type, grouping(event_type)::int as all_types, count(*)::bigint as n, round(avg(value), 6) as mean from events group by grouping sets ((event_type), ())")
def grouping_summary(spark: SparkSession, d: str) -> DataFrame:
    """Groups and the total in one pass."""
    return table(spark, d, "events").rollup("event_type").agg(F.grouping("event_type").cast("int").alias("all_types"), F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("select quality::varchar as quality, grouping(quality)::int as all_rows, count(*)::bigint as n, round(avg((quality = toxic)::int), 9) as agreement from labels group by grouping sets ((quality), ())")
def anchoring_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    same = F.avg((F.col("quality") == F.col("toxic")).cast("int"))
    out = table(spark, d, "labels").rollup("quality").agg(F.grouping("quality").cast("int").alias("all_rows"), F.count(F.lit(1)).alias("n"), F.round(same, 9).alias("agreement"))
    return out.withColumn("quality", F.col("quality").cast("string"))


@query("select metric, value, count(*)::bigint as n from (select 'quality' as metric, quality::varchar as value from labels union all select 'toxic', toxic::varchar from labels) group by all")
def value_census_unpivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select(F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return rows.unpivot([], ["quality", "toxic"], "metric", "value").groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))


@query("select metric, count(*)::bigint as n, count(distinct round(v, 6))::bigint as distinct_values, min(v) as low, max(v) as high, count(distinct round(v, 6)) > 1 as varies from (select 'value' as metric, value as v from events union all select 'user_id', user_id::double from events union all select 'constant', 1.0::double from events) group by metric")
def constant_columns(spark: SparkSession, d: str) -> DataFrame:
    """Metrics that never vary."""
    rows = table(spark, d, "events").select("value", F.col("user_id").cast("double").alias("user_id"), F.lit(1.0).alias("constant"))
    long = rows.unpivot([], ["value", "user_id", "constant"], "metric", "v")
    n = F.count_distinct(F.round("v", 6))
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), n.alias("distinct_values"), F.min("v").alias("low"), F.max("v").alias("high"), (n > 1).alias("varies"))


@query("select o_orderkey, offset_rows::bigint as offset from (select o_orderkey, coalesce(sum(n) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as offset_rows from (select o_orderkey, o_custkey, count(l_linenumber) as n from orders left join lineitem on o_orderkey = l_orderkey group by all))")
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey", "o_custkey").agg(F.count("l_linenumber").alias("n"))
    return layers.running_offsets(sizes, ["o_custkey"], "o_orderkey", "n").select("o_orderkey", "offset")


@query("select l_orderkey, l_linenumber, case when l_discount > 0.08 then 'high' when l_discount >= 0.04 then 'middle' else 'low' end as band, case when l_shipdate is null then 'undated' end as skip_reason from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F')")
def incremental_resume(spark: SparkSession, d: str) -> DataFrame:
    """The rows whose key a sink does not hold yet, banded (A31) and with their skip reason."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    band = F.when(F.col("l_discount") > 0.08, "high").when(F.col("l_discount") >= 0.04, "middle").otherwise("low")
    return table(spark, d, "lineitem").join(done, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", band.alias("band"), F.when(F.col("l_shipdate").isNull(), "undated").alias("skip_reason"))


@query("select regexp_extract(url, '^https?://([^/?#]+)', 1) as host, count(*)::bigint as pages, count(*) filter (where url like 'https:%')::bigint as secure, max(strlen(html))::bigint as longest from pages group by all")
def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The host of a URL's shape."""
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return table(spark, d, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("url").startswith("https:")).alias("secure"), F.max(F.octet_length("html")).cast("long").alias("longest"))


@query("select 'duplicate_ids' as \"check\", count(*) = count(distinct doc_id) as pass, (count(*) - count(distinct doc_id))::varchar as detail from documents union all select 'text_present', count(*) filter (where text is null) = 0, (count(*) filter (where text is null))::varchar from documents union all select 'source_present', count(*) filter (where source is null or source = '') = 0, (count(*) filter (where source is null or source = ''))::varchar from documents union all select 'chars_agree', count(*) filter (where n_chars <> length(text)) = 0, (count(*) filter (where n_chars <> length(text)))::varchar from documents union all select 'labels_known', count(*) = 0, count(*)::varchar from labels where doc_id not in (select doc_id from documents)")
def quality_checks_chunk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    counted = quality.count_violations(docs, {"text_present": F.col("text").isNull(), "source_present": F.coalesce("source", F.lit("")) == "", "chars_agree": F.col("n_chars") != F.length("text")})
    unique = quality.unique_key(docs, "doc_id", "duplicate_ids")
    orphans = quality.no_orphans(table(spark, d, "labels"), docs, "doc_id", "labels_known")
    return counted.union(unique).union(orphans)


@query("select 'finite' as \"check\", count(*) filter (where len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) > 0) = 0 as pass, (count(*) filter (where len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) > 0))::varchar as detail from embeddings union all select 'dimension', count(distinct len(embedding)) = 1, (count(*) filter (where len(embedding) <> 64))::varchar from embeddings union all select 'duplicate_ids', count(*) = count(distinct vec_id), (count(*) - count(distinct vec_id))::varchar from embeddings union all select 'unit_norm', count(*) filter (where abs(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) - 1) > 1e-3) = 0, (count(*) filter (where abs(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) - 1) > 1e-3))::varchar from embeddings")
def quality_checks_index(spark: SparkSession, d: str) -> DataFrame:
    """Q02: vectors finite, of one dimension and of unit length, ids unique."""
    e, v = table(spark, d, "embeddings"), F.col("embedding")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    odd = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    counted = quality.count_violations(e, {"finite": odd, "unit_norm": F.abs(norm - 1) > 1e-3, "dimension": F.size(v) != 64})
    return counted.union(quality.unique_key(e, "vec_id", "duplicate_ids"))


@query("select conv_id, count(*)::bigint as turns, bool_and(ok) as roles_alternate, count(*) filter (where trim(coalesce(text, '')) = '')::bigint as blank from (select *, role is distinct from lag(role) over (partition by conv_id order by turn) as ok from conversations) group by conv_id")
def conversation_checks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").withColumn("ok", ~F.col("role").eqNullSafe(before))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.bool_and("ok").alias("roles_alternate"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))


@query("select r.doc_id, r.quality, d.doc_id is null as missing from labels r left join documents d using (doc_id) where d.doc_id is null or r.quality not in (0, 1) or r.quality is null")
def completeness_check(spark: SparkSession, d: str) -> DataFrame:
    """Labels without a document or outside their range."""
    ids = table(spark, d, "documents").select("doc_id").distinct().withColumn("_there", F.lit(True))
    rows = table(spark, d, "labels").join(ids, "doc_id", "left")
    return rows.where(F.col("_there").isNull() | F.col("quality").isNull() | ~F.col("quality").isin(0, 1)).select("doc_id", "quality", F.col("_there").isNull().alias("missing"))


@query("select l.doc_id, p.page_id is null as no_page, l.toxic from labels l left join pages p on p.page_id = l.doc_id where p.page_id is null or l.toxic <> 0")
def completeness_of_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that are incomplete (no page) or outside what is expected, none dropped."""
    pages = table(spark, d, "pages").select("page_id").distinct()
    rows = table(spark, d, "labels").join(pages, F.col("doc_id") == F.col("page_id"), "left")
    return rows.where(F.col("page_id").isNull() | (F.col("toxic") != 0)).select("doc_id", F.col("page_id").isNull().alias("no_page"), "toxic")


@query("with n as (select length(text) as n from documents where trim(coalesce(text, '')) <> '') select (select count(*) from documents)::bigint as keys, (select count(*) from documents where doc_id not in (select doc_id from labels))::bigint as unlabelled, (select min(n) from n)::bigint as shortest, (select list_sort(list(n))[(len(list(n)) // 2) + 1] from n)::bigint as upper_median")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """Keys without a partner, the shortest text and the upper median length."""
    docs = table(spark, d, "documents")
    missing = docs.join(table(spark, d, "labels"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("unlabelled"))
    return docs.agg(F.count(F.lit(1)).alias("keys")).crossJoin(missing).crossJoin(quality.upper_median(docs.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(F.length("text").cast("long").alias("n")), "n"))


@query("select quality, count(*)::bigint as n, round(100.0 * avg((toxic = 0)::int), 6) as accuracy from labels group by quality")
def accuracy_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy in per cent for each group."""
    return table(spark, d, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.avg((F.col("toxic") == 0).cast("int")), 6).alias("accuracy"))


@query("select count(*)::bigint as n, round(avg((quality = 1 - toxic)::int), 9) as accuracy, coalesce(round(avg((quality = 1 - toxic)::int) filter (where quality = 1), 9), -1.0) as accuracy_1, coalesce(round(avg((quality = 1 - toxic)::int) filter (where quality = 0), 9), -1.0) as accuracy_0, count(*) filter (where 1 - toxic = 1)::bigint as predicted_1, count(*) filter (where quality = 1)::bigint as gold_1 from labels")
def filter_metrics(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.operators import compare

    return compare.confusion(table(spark, d, "labels").withColumn("guess", 1 - F.col("toxic")), "quality", "guess")


@query("select conv_id, turn, length(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')))::int as norm_length, trim(BOTH ' .:' FROM trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) as title from conversations")
def text_norms(spark: SparkSession, d: str) -> DataFrame:
    """X01, X10, X11."""
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.length(X.question_norm(t)).alias("norm_length"), X.title_norm(t).alias("title"))
