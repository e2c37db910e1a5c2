"""Queries that select, split, order and unite rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalog import query, table
from lodestar.operators import order, retrieve, select
from lodestar.plans.evidence import CAND, decisions


@query("select doc_id, source from documents where lang = 'en' and contains(lower(coalesce(source, '') || ' ' || text), 'the')")
def domain_filter(spark: SparkSession, d: str) -> DataFrame:
    """One layer (pushed to the scan) and a term in title or text."""
    text = F.lower(F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.col("text")))
    return table(spark, d, "documents").where((F.col("lang") == "en") & text.contains("the")).select("doc_id", "source")


URL = r"^https?://[^/?#]+\.example\.(com|org)(/.*)?$"


@query(f"select page_id, url, case when coalesce(regexp_matches(url, '{URL}'), false) then 'valid' else 'malformed' end as part from pages")
def split_valid_malformed(spark: SparkSession, d: str) -> DataFrame:
    """Two outputs of one scan."""
    good, bad = select.split_valid(table(spark, d, "pages").select("page_id", "url"), F.col("url").rlike(URL))
    return good.withColumn("part", F.lit("valid")).union(bad.withColumn("part", F.lit("malformed")))


@query(f"with {CAND} select a.event_id, a.user_id, a.value, k.score, k.admitted from (select event_id, user_id, value from adm) a join adm k using (event_id)")
def blind_key_split(spark: SparkSession, d: str) -> DataFrame:
    """The sheet that an annotator sees and the key, met again by id."""
    sheet, key = select.blind(decisions(spark, d), "event_id", ["user_id", "value"])
    return sheet.join(key.select("event_id", "score", "admitted"), "event_id")


@query(f"with {CAND}, m as (select event_id, value, length(event_type)::double / 10 as answer from adm) select adm.event_id, answer, basis from adm join m using (event_id)")
def metadata_isolation(spark: SparkSession, d: str) -> DataFrame:
    """Only id and text reach the scorer; what is known of the source joins its answer afterwards."""
    rows = decisions(spark, d)
    seen = rows.select("event_id", F.col("event_type").alias("text"))
    answered = seen.select("event_id", (F.length("text").cast("double") / 10).alias("answer"))
    return rows.select("event_id", "basis").join(answered, "event_id").select("event_id", "answer", "basis")


def _fallback_sql(mode: str) -> str:
    kept = "kept or (n_kept = 0 and rank = best)" if mode == "keep_top1" else "kept"
    return f"with {CAND}, a as (select event_id, user_id, rank, admitted and score >= 0.8 as kept from adm), s as (select user_id, max(kept::int) as n_kept, min(rank) as best from a group by user_id) select event_id, {kept} as kept, case when n_kept = 0 then '{mode}' end as fallback from a join s using (user_id)"


def _fallback(spark: SparkSession, d: str, mode: str) -> DataFrame:
    rows = decisions(spark, d).select("event_id", "user_id", "rank", (F.col("admitted") & (F.col("score") >= 0.8)).alias("kept"))
    return select.with_fallback(rows, "user_id", "rank", "kept", mode).select("event_id", "kept", "fallback")


@query(_fallback_sql("keep_top1"))
def empty_keep_top1(spark: SparkSession, d: str) -> DataFrame:
    """P14."""
    return _fallback(spark, d, "keep_top1")


@query(_fallback_sql("no_evidence"))
def empty_no_evidence(spark: SparkSession, d: str) -> DataFrame:
    """P14."""
    return _fallback(spark, d, "no_evidence")


@query(f"with {CAND} select user_id, count(*)::bigint as passthrough, 0::bigint as none from adm group by user_id")
def passthrough_and_none(spark: SparkSession, d: str) -> DataFrame:
    """The filter that keeps all and the one that keeps none."""
    rows = decisions(spark, d).withColumns({"all": F.lit(True), "nothing": F.lit(False)})
    return rows.groupBy("user_id").agg(F.count_if("all").alias("passthrough"), F.count_if("nothing").alias("none"))


@query("select item_id, text from benchmark order by item_id limit 25")
def first_n(spark: SparkSession, d: str) -> DataFrame:
    """A report's first rows; the order is stated, so the rows are always the same."""
    return table(spark, d, "benchmark").orderBy("item_id").limit(25)


@query("select user_id, event_type, min(event_id) as place from events group by all")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Types of each user in the order in which they first came."""
    return select.ordered_distinct(table(spark, d, "events").withColumnRenamed("event_id", "place"), ["user_id", "event_type"], "place")


@query("select conv_id, count(*)::bigint as turns, string_agg(role, ',' order by turn, role) as roles, string_agg(turn::varchar, ',' order by turn, role) as places from conversations group by conv_id")
def group_by_document(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's turns as one ordered list; its length is that of one document."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), parts.alias("p"))
    return rows.select("conv_id", "turns", F.array_join(F.transform("p", lambda x: x["role"]), ",").alias("roles"), F.array_join(F.transform("p", lambda x: x["turn"].cast("string")), ",").alias("places"))


CASE = "case when admitted and not other then 'first_only' when other and not admitted then 'second_only' when admitted and other then 'both' else 'neither' end"


@query(f"""with {CAND}, j as (select *, support >= 0.5 as other from adm), c as (select *, {CASE} as tag from j),
h as (select tag || '_highest' as "case", event_id, row_number() over (partition by tag order by score desc, event_id)::int as place from c), l as (select tag || '_lowest', event_id, row_number() over (partition by tag order by score, event_id)::int as place from c)
select * from h where place <= 2 union all select * from l where place <= 2""")
def extreme_cases(spark: SparkSession, d: str) -> DataFrame:
    """The two highest and lowest scores where the arms agree and where they differ."""
    rows = decisions(spark, d).withColumn("other", F.col("support") >= 0.5)
    a, b = F.col("admitted"), F.col("other")
    tag = F.when(a & ~b, "first_only").when(b & ~a, "second_only").when(a & b, "both").otherwise("neither")
    ends = [select.extremes(rows, F.concat(tag, F.lit(s)), F.col("score"), "event_id", 2, high).select("case", "event_id", "place") for s, high in (("_highest", True), ("_lowest", False))]
    return ends[0].union(ends[1])


@query(f"with {CAND} select event_id, user_id, rank from adm where rank <= 10")
def ranking_depth(spark: SparkSession, d: str) -> DataFrame:
    """A given ranking cut at a depth, never ordered anew."""
    return decisions(spark, d).where("rank <= 10").select("event_id", "user_id", "rank")


@query("select c_name, row_number() over (order by regexp_extract(c_name, '(\\d+)$', 1)::bigint, c_name)::bigint as place from customer")
def numeric_suffix_order(spark: SparkSession, d: str) -> DataFrame:
    """Names by the number they end with."""
    rows = table(spark, d, "customer").select("c_name", select.numbers_in(F.col("c_name"), r"(\d+)$")["n0"].alias("n"))
    return order.places(rows, ["n", "c_name"], "place").select("c_name", (F.col("place") + 1).alias("place"))


@query("select l_orderkey, arg_max(l_partkey::varchar || '.v' || l_linenumber, l_linenumber) as newest, max(l_linenumber) as version from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey) as k from lineitem) where k = 1 group by l_orderkey")
def newest_version(spark: SparkSession, d: str) -> DataFrame:
    """Of each document's keys the one with the highest numeric version."""
    keys = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.concat(F.col("l_partkey").cast("string"), F.lit(".v"), F.col("l_linenumber").cast("string")).alias("key"))
    version = F.regexp_extract("key", r"\.v(\d+)$", 1).cast("int")
    best = keys.groupBy("l_orderkey").agg(F.max_by("key", F.struct(version, -F.col("l_partkey"))).alias("newest"), F.max(version).alias("version"))
    return best


@query("select p_type, count(*)::bigint as n, (select count(distinct p_type) from part)::bigint as \"of\" from part group by p_type order by n desc, p_type limit 5")
def display_capped(spark: SparkSession, d: str) -> DataFrame:
    """Five rows are shown, all are counted."""
    return select.most_common(table(spark, d, "part"), "p_type", 5)


@query("select event_type, count(*)::bigint as n, (select count(distinct event_type) from events)::bigint as \"of\" from events group by event_type")
def most_common(spark: SparkSession, d: str) -> DataFrame:
    """O06."""
    return select.most_common(table(spark, d, "events"), "event_type")


@query("select doc_id as id, 0 as layer from labels where quality = 1 union all select doc_id, 1 from documents where doc_id not in (select doc_id from labels where quality = 1 and doc_id is not null)")
def layer_union(spark: SparkSession, d: str) -> DataFrame:
    """U01."""
    first = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return select.union_of_layers(first, table(spark, d, "documents").select(F.col("doc_id").alias("id")), "id")


@query(f"with {CAND}, p as (select user_id, event_id, rank, row_number() over (partition by user_id order by score desc, event_id) as again from adm) select user_id, count(*)::bigint as n, count(*) filter (where rank <> again) = 0 as same from p group by user_id")
def sequence_equality(spark: SparkSession, d: str) -> DataFrame:
    """Whether a second ranking orders a question's candidates as the first did."""
    again = retrieve.rerank(decisions(spark, d), "user_id", "score", "event_id").withColumnRenamed("rerank_rank", "again")
    return select.same_sequence(again, "user_id", "event_id", "rank", "again")


@query("select l_partkey as id, min(place) as place from (select l_partkey, l_orderkey as place from lineitem where l_shipdate < timestamp '1995-01-01' union all select l_partkey, 1000000000 + l_orderkey from lineitem where l_shipdate >= timestamp '1995-01-01') group by l_partkey")
def merge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Ids of an earlier window, then new ones of a later window."""
    rows = table(spark, d, "lineitem")
    late = F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")
    halves = [rows.where(~late).select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("place")), rows.where(late).select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") + 1_000_000_000).alias("place"))]
    return select.ordered_distinct(halves[0].union(halves[1]), ["id"], "place")


@query("""with p as (select doc_id, max(quality) as quality from labels group by doc_id), e as (select distinct doc_id from labels where toxic = 1)
select o.o_orderkey, coalesce(a.quality, b.quality) as policy, o.o_orderkey in (select doc_id from e) or o.o_custkey in (select doc_id from e) as excluded from orders o left join p a on a.doc_id = o.o_orderkey left join p b on b.doc_id = o.o_custkey""")
def dual_index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One table looked up by a first key, else by a second, with the set of excluded keys."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max(F.col("toxic")).alias("toxic"))
    side = lambda n: labels.select(F.col("doc_id").alias(f"k{n}"), F.col("quality").alias(f"q{n}"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias(f"x{n}"))
    rows = table(spark, d, "orders").join(side(1), F.col("o_orderkey") == F.col("k1"), "left").join(side(2), F.col("o_custkey") == F.col("k2"), "left")
    return rows.select("o_orderkey", F.coalesce("q1", "q2").alias("policy"), (F.coalesce("x1", F.lit(False)) | F.coalesce("x2", F.lit(False))).alias("excluded"))
