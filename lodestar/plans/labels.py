"""Queries over labels, samples, models and licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalog import query, table
from lodestar.functions import licences
from lodestar.functions import text as X
from lodestar.operators import label, model, stats
from lodestar.plans import corpus, evidence
from lodestar.stored import write_once

H = "md5('7:' || {})"


@query(f"select doc_id, quality, row_number() over (partition by quality, toxic order by {H.format('doc_id')}, doc_id)::int as draw from labels qualify draw <= 10")
def human_subset(spark: SparkSession, d: str) -> DataFrame:
    return label.per_stratum(table(spark, d, "labels"), ["quality", "toxic"], "doc_id", 10, 7).select("doc_id", "quality", "draw")


@query(f"""with {evidence.EDGES}, c as (select event_id, event_type || '/' || case when value < edge_low then 'low' when value < edge_high then 'medium' else 'high' end as cell, event_id % 977 = 0 as f from events, edges),
r as (select event_id, cell, false as forced, row_number() over (partition by cell order by {H.format('event_id')}, event_id)::int as draw from c where not f qualify draw <= 120 union all select event_id, cell, true, 0 from c where f),
p as (select *, row_number() over (order by forced desc, draw, cell, event_id)::int as place from r) select event_id, cell, forced, place from p where forced or place <= 120""")
def stratified_cells(spark: SparkSession, d: str) -> DataFrame:
    """W13 over event types and tertiles, with every 977th event forced in."""
    e = table(spark, d, "events")
    rows = e.crossJoin(F.broadcast(stats.tertile_edges(e, "value")))
    rows = rows.select("event_id", F.concat_ws("/", "event_type", stats.bin_of(F.col("value"), F.col("edge_low"), F.col("edge_high"))).alias("cell"))
    return label.round_robin(rows, "cell", "event_id", F.col("event_id") % 977 == 0, 120, 7).select("event_id", "cell", "forced", "place")


@query(f"""with {corpus.BM25}, pool as (select doc_id from documents order by {H.format('doc_id')}, doc_id limit 200), pr as (select item_id, pool.doc_id from benchmark, pool where not exists (select 1 from s where s.item_id = benchmark.item_id and s.doc_id = pool.doc_id))
select item_id, doc_id, row_number() over (partition by item_id order by md5('7:' || item_id || ':' || doc_id), doc_id)::int as draw from pr qualify draw <= 3""")
def easy_negatives(spark: SparkSession, d: str) -> DataFrame:
    """What matters of the corpus is in how many documents a term of the pool and a question is; only the pool is matched."""
    from lodestar.operators import retrieve

    docs, items, tokens = table(spark, d, "documents"), table(spark, d, "benchmark"), X.training_tokens(F.col("text"))
    pool = write_once(docs.select("doc_id", "text").orderBy(label.draw_key(7, "doc_id"), "doc_id").limit(200), "pool")
    met = write_once(retrieve.terms(pool, "doc_id", tokens).join(retrieve.terms(items, "item_id", tokens), "term"), "met")
    frequency = retrieve.document_frequency(retrieve.terms(docs, "doc_id", tokens), F.broadcast(met.select("term").distinct()))  # terms of 200 documents
    kept = frequency.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))).where(F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.10))))
    matches = met.join(kept.select("term"), "term", "left_semi").select("item_id", "doc_id").distinct()
    return label.easy_negatives(items, pool, matches, "item_id", "doc_id", 3, 7, 200).select("item_id", "doc_id", "draw")


@query("with b as (select conv_id, min(turn) filter (where length(text) > 400) as bad from conversations group by conv_id) select c.conv_id, c.turn from conversations c join b using (conv_id) where bad is null or turn < bad")
def valid_prefix(spark: SparkSession, d: str) -> DataFrame:
    return label.longest_valid_prefix(table(spark, d, "conversations"), "conv_id", "turn", F.coalesce(F.length("text") <= 400, F.lit(True))).select("conv_id", "turn")


@query("with s as (select l_suppkey, l_orderkey, case when l_returnflag <> 'N' then 1 end as lab from lineitem) select l_suppkey, coalesce(min(l_orderkey) filter (where lab is null and l_orderkey > 100), min(l_orderkey) filter (where lab is null))::bigint as next, count(lab)::bigint as done, count(*)::bigint as total from s group by l_suppkey")
def next_unlabelled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("lab", F.when(F.col("l_returnflag") != "N", 1))
    return label.next_unlabelled(rows, "l_suppkey", "l_orderkey", "lab", 100)


@query("select event_id, case when substr(md5('7:' || event_id), 1, 1) in ('0', '1', '2', '3', '4', '5', '6', '7') then user_id else event_id end::bigint as older, case when substr(md5('7:' || event_id), 1, 1) in ('0', '1', '2', '3', '4', '5', '6', '7') then event_id else user_id end::bigint as newer from events")
def permutation_control(spark: SparkSession, d: str) -> DataFrame:
    a, b = label.permute_sides(F.col("event_id"), F.col("user_id"), label.draw_key(7, "event_id"))
    return table(spark, d, "events").select("event_id", a.alias("older"), b.alias("newer"))


@query("select doc_id, keep, case when keep then 'HELPFUL' else 'NOT_HELPFUL' end as label from (select doc_id, ('0x' || substr(sha256(coalesce(text, '')), 1, 12))::bigint / 281474976710656.0 >= 0.5 as keep from documents)")
def stub_filter(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct text scored once by the stub, decided by threshold."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    return model.decide(model.score_once(rows, ["doc_id"], F.coalesce("text", F.lit("")), model.stub_probability), "p").select("doc_id", "keep", "label")


@query("select item_id, substr('ABCD', (floor(('0x' || substr(sha256(text), 1, 12))::bigint / 281474976710656.0 * 4) + 1)::int, 1) as choice from benchmark")
def stub_answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", model.stub_choice(F.col("text")).alias("choice"))


@query()
def model_seam(spark: SparkSession, d: str) -> DataFrame:
    """a scripted scorer behind the pandas UDF."""
    score = model.scorer(lambda: lambda texts: [len(set(t.split())) / max(1, len(t.split())) for t in texts])
    return table(spark, d, "benchmark").select("item_id", score("text").alias("p"))


URLS = "u as (select page_id, case page_id % 7 when 0 then 'http://creativecommons.org/licenses/by-nc-nd/4.0/' when 1 then 'https://creativecommons.org/licenses/by/4.0/' when 2 then 'CC BY-NC' when 3 then 'https://creativecommons.org/publicdomain/zero/1.0/' when 4 then 'text and data mining permitted' when 5 then '' else 'all rights reserved' end as ref from pages)"


@query(f"""with {URLS}, k as (select page_id, case when lower(ref) ~ '.*by[-_ ]nc[-_ ]nd.*' then 'cc-by-nc-nd' when lower(ref) ~ '.*by[-_ ]nc[-_ ]sa.*' then 'cc-by-nc-sa' when lower(ref) ~ '.*by[-_ ]nc.*' then 'cc-by-nc' when lower(ref) ~ '.*by[-_ ]nd.*' then 'cc-by-nd' when lower(ref) ~ '.*by[-_ ]sa.*' then 'cc-by-sa' when lower(ref) ~ '.*(publicdomain/zero|cc0).*' then 'cc0' when lower(ref) ~ '.*(licenses/by/|cc[-_ ]by).*' then 'cc-by' when lower(ref) ~ '.*text[- ]and[- ]data[- ]mining.*' then 'tdm' else '' end as code, ref from u)
select page_id, code, case when code in ('cc-by', 'cc-by-sa', 'cc0') then 'open' when code = 'tdm' then 'tdm' when code <> '' then 'cc-restrictive' when trim(ref) = '' then 'none' else 'other' end as band from k""")
def licence_normalise(spark: SparkSession, d: str) -> DataFrame:
    refs = ["http://creativecommons.org/licenses/by-nc-nd/4.0/", "https://creativecommons.org/licenses/by/4.0/", "CC BY-NC", "https://creativecommons.org/publicdomain/zero/1.0/", "text and data mining permitted", "", "all rights reserved"]
    ref = F.element_at(F.array(*map(F.lit, refs)), (F.col("page_id") % 7 + 1).cast("int"))
    code = licences.code(ref)
    return table(spark, d, "pages").select("page_id", code.alias("code"), licences.band(code, ref).alias("band"))


ABBREVIATED = "(?i)(^|[\\s\\x01])([(,;:]*(?:" + "|".join(licences.ABBREVIATIONS) + ")[.),;:]*)\\x01"


def sentences_sql(text: str) -> str:
    """Marks where a sentence ends, takes the marks after abbreviations off, splits."""
    marked = f"regexp_replace(trim({text}, ' ' || chr(9) || chr(10) || chr(13)), '([.!?])\\s+([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g')"
    for _ in range(2):
        marked = f"regexp_replace({marked}, '{ABBREVIATED}', '\\1\\2 ', 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: trim(s) <> '')"


@query(f"select doc_id, (i - 1)::int as n, ss[i] as sentence from (select doc_id, ss, unnest(generate_series(1, len(ss))) as i from (select doc_id, {sentences_sql("coalesce(text, '')")} as ss from documents))")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every text, none cut after an abbreviation."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(licences.sentences(F.coalesce("text", F.lit("")))).alias("n", "sentence"))


@query("select doc_id, case when length(x) > 400 then rtrim(substr(x, 1, 397)) || '...' else x end as summary from (select doc_id, trim(regexp_extract(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^(?:.*?[.!?]\\s+){0,1}.*?(?:[.!?](?:\\s|$)|$)')) as x from documents where text is not null)")
def lead_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.lead_summary(F.col("text")).alias("summary"))


@query("select conv_id, 'What is known about ' || text || '?' as q, conv_id % 4 = 0 as framed from conversations where turn = 0 and length(text) between 15 and 220 and text not like '%?%' and len(string_split(text, ' ')) >= 4")
def question_framing(spark: SparkSession, d: str) -> DataFrame:
    """X14, X15 on opening turns: those whole enough become a question."""
    t = F.col("text")
    whole = F.length(t).between(15, 220) & ~t.contains("?") & (F.size(F.split(t, " ")) >= 4)
    return table(spark, d, "conversations").where((F.col("turn") == 0) & whole).select("conv_id", X.fill("What is known about {need}?", need=t).alias("q"), (F.col("conv_id") % 4 == 0).alias("framed"))


@query(f"""with {evidence.ARMS}, f as (select user_id, sha256(string_agg(event_id::varchar, chr(0) order by event_id) filter (where sa is not null)) as da, sha256(string_agg(event_id::varchar, chr(0) order by event_id) filter (where sb is not null)) as db from arms group by user_id)
select 'same_candidates' as "check", count(*) filter (where da is distinct from db) = 0 as pass, (count(*) filter (where da is distinct from db))::varchar as detail from f union all select 'unique_candidates', count(*) = count(distinct (user_id, event_id)), (count(*) - count(distinct (user_id, event_id)))::varchar from arms union all select 'finite_scores', count(*) filter (where sa is null or sb is null) = 0, (count(*) filter (where sa is null or sb is null))::varchar from arms""")
def fairness_report(spark: SparkSession, d: str) -> DataFrame:
    """Both arms scored the same candidates, each once, with finite scores."""
    from lodestar.operators import quality

    arms = evidence._arms(spark, d).withColumn("key", F.concat_ws(":", "user_id", "event_id"))
    seen = lambda score: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(score).isNotNull(), F.col("event_id")))), lambda x: x.cast("string")), "\x00"), 256)
    digests = arms.groupBy("user_id").agg(seen("sa").alias("da"), seen("sb").alias("db"))
    same = quality.count_violations(digests, {"same_candidates": ~F.col("da").eqNullSafe(F.col("db"))})
    finite = quality.count_violations(arms, {"finite_scores": F.col("sa").isNull() | F.col("sb").isNull()})
    return same.union(quality.unique_key(arms, "key", "unique_candidates")).union(finite)
