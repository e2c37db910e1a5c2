"""Queries over the corpus: chunks, tokens, frequencies, lexical and BM25 ranking, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalog import query, table
from lodestar.functions import text as X
from lodestar.operators import impact, layers, retrieve
from lodestar.stored import write_once

DEPTH = 20


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


T1 = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9\\-'']+'), lambda t: not list_contains({sql_list(X.POLICY_STOP)}, t))"
T2 = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: len(t) > 1 and not list_contains({sql_list(X.TRAINING_STOP)}, t))"
T3 = f"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9\\-]*'), lambda t: lower(t)), lambda t: len(t) > 2 and not list_contains({sql_list(X.ANNOTATION_STOP)}, t)))"
CHUNKS = r"""
words as (select doc_id, lang, source, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' '), lambda w: w <> '') as ws from documents),
starts as (select *, unnest(generate_series(0, greatest(len(ws) - 1, 0), 224)) as s from words where len(ws) > 0),
chunks as (select doc_id, lang, source, (s / 224)::int as chunk_index, s::int as window_start, array_to_string(list_slice(ws, s + 1, s + 256), ' ') as text,
  len(list_slice(ws, s + 1, s + 256))::bigint as word_count, doc_id::varchar || '#body.w' || ((s / 224)::int)::varchar as chunk_id,
  sha256(array_to_string(list_slice(ws, s + 1, s + 256), ' ')) as text_sha256
  from starts where s = 0 or (s - 224 + 256 < len(ws) and len(ws) - s >= 20))
"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return layers.chunks(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark")


@query(f"with {CHUNKS} select chunk_id, doc_id, chunk_index, window_start, word_count, text_sha256 from chunks")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", "doc_id", "chunk_index", "window_start", "word_count", "text_sha256")


@query(f"""with {CHUNKS}, f as (select chunk_id, first_value(chunk_id) over (partition by text_sha256 order by doc_id, chunk_index) as first from chunks)
select chunk_id, case when chunk_id = first then '' else first end as duplicate_of from f""")
def chunk_dedup_flag(spark: SparkSession, d: str) -> DataFrame:
    return layers.flag_duplicates(_chunks(spark, d), "text_sha256", "chunk_id", "doc_id", "chunk_index").select("chunk_id", "duplicate_of")


@query(f"""with {CHUNKS} select source, lang, count(*)::bigint as chunks, count(distinct text_sha256)::bigint as unique_texts, sum(word_count)::bigint as words, max(chunk_index)::int as last_index from chunks group by all""")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d)
    per = rows.groupBy("source", "lang", "text_sha256").agg(F.count(F.lit(1)).alias("c"), F.sum("word_count").alias("w"), F.max("chunk_index").alias("m"))
    return per.groupBy("source", "lang").agg(F.sum("c").alias("chunks"), F.count(F.lit(1)).alias("unique_texts"), F.sum("w").alias("words"), F.max("m").alias("last_index"))


@query("select doc_id, concat_ws(' | ', nullif(trim(lang), ''), nullif(trim(source), ''), nullif(trim(text), '')) as embed_text from documents")
def embed_text_compose(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.embed_text(F.col("lang"), F.col("source"), F.col("text")).alias("embed_text"))


@query(f"select doc_id, len({T1})::bigint as t1, len({T2})::bigint as t2, len({T3})::bigint as t3, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::bigint as t4 from documents")
def tokens_counts(spark: SparkSession, d: str) -> DataFrame:
    t, n = F.col("text"), lambda c: F.size(c).cast("long")
    return table(spark, d, "documents").select("doc_id", n(X.policy_tokens(t)).alias("t1"), n(X.training_tokens(t)).alias("t2"), n(X.annotation_terms(t)).alias("t3"), X.word_count(t).alias("t4"))


Q_TERMS = f"q as (select item_id, unnest(list_distinct({T1})) as term from benchmark)"
C_TERMS = f"uniq as (select min(doc_id) as doc_id, min_by(chunk_id, (doc_id, chunk_index)) as chunk_id, text_sha256, any_value(text) as text from chunks group by text_sha256), c as (select chunk_id, unnest(list_distinct({T1})) as term from uniq)"


def _unique_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d)
    return rows.groupBy("text_sha256").agg(F.min_by("chunk_id", F.struct("doc_id", "chunk_index")).alias("chunk_id"), F.any_value("text").alias("text"))


def _q_terms(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.terms(_questions(spark, d), "item_id", X.policy_tokens(F.col("text")))


def _c_terms(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.terms(_unique_chunks(spark, d), "chunk_id", X.policy_tokens(F.col("text")))


@query(f"with {CHUNKS}, {Q_TERMS}, {C_TERMS}, w as (select distinct term from q) select w.term, count(c.chunk_id)::bigint as df from w left join c using (term) group by w.term")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.document_frequency(_c_terms(spark, d), _q_terms(spark, d).select("term").distinct())


LEXICAL = f"""with {CHUNKS}, {Q_TERMS}, {C_TERMS}, hits as (select c.* from c semi join q using (term)),
n as (select count(distinct chunk_id) as n from hits), idf as (select term, ln((n + 1.0) / (count(*) + 0.5)) as idf from hits, n group by term, n),
wq as (select item_id, q.term, coalesce(idf, 1.0) as idf from q left join idf using (term)), tot as (select item_id, sum(idf) as total from wq group by item_id),
sc as (select item_id, chunk_id, round(sum(idf) / any_value(total), 9) as score from hits join wq using (term) join tot using (item_id) group by item_id, chunk_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, chunk_id)::int as rank from sc where score > 0 qualify rank <= {DEPTH})"""


@query(f"{LEXICAL} select item_id, chunk_id, score, rank from ranked")
def lexical_top20(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.lexical(_q_terms(spark, d), _c_terms(spark, d), "item_id", "chunk_id", DEPTH).select("item_id", "chunk_id", "score", "rank")


@query(f"""{LEXICAL} select item_id, string_agg('[' || rank || '] ' || uniq.text, chr(10) order by rank) as context, count(*)::bigint as n_passages
from ranked join uniq using (chunk_id) where rank <= 5 group by item_id""")
def evidence_context(spark: SparkSession, d: str) -> DataFrame:
    best = retrieve.lexical(_q_terms(spark, d), _c_terms(spark, d), "item_id", "chunk_id", DEPTH).where("rank <= 5")
    texts = _chunks(spark, d).select("chunk_id", "text")  # only the winners' texts are met, by the small side
    few = retrieve._few(_questions(spark, d))
    return retrieve.context(texts.join(F.broadcast(best) if few else best, "chunk_id"), "item_id", "rank", "text")


BM25 = f"""d as (select doc_id, {T2} as t from documents), st as (select count(*) as n, avg(len(t)) as avgdl from d),
p as (select doc_id, len(t) as dl, term, count(*) as tf from (select doc_id, t, unnest(t) as term from d) group by all),
k as (select term, count(*) as df, any_value(n) as n, any_value(avgdl) as avgdl from p, st group by term having count(*) <= greatest(1, floor(any_value(n) * 0.10))),
bq as (select distinct item_id, term from (select item_id, unnest({T2}) as term from benchmark)),
s as (select item_id, doc_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))), 9) as score from p join k using (term) join bq using (term) group by item_id, doc_id),
br as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s)"""


def _bm25(spark: SparkSession, d: str, depth: int) -> DataFrame:
    asked = retrieve.terms(_questions(spark, d), "item_id", X.training_tokens(F.col("text")))
    postings, _ = retrieve.bm25_index(table(spark, d, "documents"), "doc_id", X.training_tokens(F.col("text")), wanted=asked.select("term").distinct())
    scores = retrieve.bm25(postings, asked, "item_id", "doc_id")
    return retrieve.top(scores, ["item_id"], [F.desc("score"), F.col("doc_id")], depth)


@query(f"with {BM25} select item_id, doc_id, score, rank from br where rank <= 10")
def bm25_pruned_top10(spark: SparkSession, d: str) -> DataFrame:
    """The same ten from stored impacts and maxima, most pairs never scored."""
    asked = retrieve.terms(_questions(spark, d), "item_id", X.training_tokens(F.col("text")))
    index = impact.build(table(spark, d, "documents"), "doc_id", X.training_tokens(F.col("text")), asked.select("term").distinct())
    return impact.search(index, asked, "item_id", "doc_id", 10)[0]


@query(f"with {BM25} select item_id, doc_id, score, rank from br where rank <= 10")
def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, 10).select("item_id", "doc_id", "score", "rank")


@query(f"with {BM25}, own as (select item_id, min(doc_id) as own from br where rank = 1 group by item_id) select item_id, doc_id, rank from br join own using (item_id) where rank between 6 and 30 and doc_id <> own")
def bm25_hard_negative_band(spark: SparkSession, d: str) -> DataFrame:
    ranked = _bm25(spark, d, 30)
    own = ranked.where("rank = 1").select("item_id", F.col("doc_id").alias("own"))
    return ranked.where("rank between 6 and 30").join(own, "item_id").where("doc_id <> own").select("item_id", "doc_id", "rank")


@query(f"with {BM25} select count(*)::bigint as terms, sum(df)::bigint as postings, max(df)::bigint as max_df, any_value(n)::bigint as n, round(any_value(avgdl), 9) as avgdl from k")
def bm25_index_stats(spark: SparkSession, d: str) -> DataFrame:
    postings, stats = retrieve.bm25_index(table(spark, d, "documents"), "doc_id", X.training_tokens(F.col("text")))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    found = terms.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"), F.max("df").alias("max_df"))
    return found.crossJoin(F.broadcast(stats)).select("terms", "postings", "max_df", "n", F.round("avgdl", 9).alias("avgdl"))


JACCARD = f"""dt as (select doc_id, list_distinct({T1}) as ts from documents), bt as (select item_id, list_distinct({T1}) as ts from benchmark),
du as (select doc_id, len(ts) as n, unnest(ts) as term from dt), bu as (select item_id, len(ts) as n, unnest(ts) as term from bt),
pairs as (select bu.item_id, du.doc_id, round(count(*) / (any_value(bu.n) + any_value(du.n) - count(*)), 9) as j from bu join du using (term) group by all)"""


@query(f"with {JACCARD}, r as (select *, row_number() over (partition by item_id order by j desc, doc_id) as k from pairs) select b.item_id, r.doc_id, coalesce(r.j, 0.0) as jaccard from benchmark b left join r on b.item_id = r.item_id and r.k = 1")
def leakage_jaccard_max(spark: SparkSession, d: str) -> DataFrame:
    """J10 by a token equi-join: pairs without a common token are 0 and need not be made."""
    sized = lambda df, id_, n: df.select(id_, F.array_distinct(X.policy_tokens(F.col("text"))).alias("t")).select(id_, F.size("t").alias(n), F.explode("t").alias("term"))
    items, docs = sized(_questions(spark, d), "item_id", "nb"), sized(table(spark, d, "documents"), "doc_id", "nd")
    pairs = docs.join(F.broadcast(items) if retrieve._few(items) else items, "term").groupBy("item_id", "doc_id", "nb", "nd").agg(F.count(F.lit(1)).alias("c"))
    pairs = pairs.withColumn("j", F.round(F.col("c") / (F.col("nb") + F.col("nd") - F.col("c")), 9))
    best = pairs.groupBy("item_id").agg(F.max(F.struct("j", (-F.col("doc_id")).alias("m"))).alias("b"))
    return _questions(spark, d).select("item_id").join(best, "item_id", "left").select("item_id", (-F.col("b.m")).alias("doc_id"), F.coalesce("b.j", F.lit(0.0)).alias("jaccard"))


NORM = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


@query(f"select doc_id from documents where text is not null and {NORM} in (select {NORM} from benchmark)")
def leakage_exact(spark: SparkSession, d: str) -> DataFrame:
    items = _questions(spark, d).select(X.question_norm(F.col("text")).alias("norm")).distinct()
    return table(spark, d, "documents").withColumn("norm", X.question_norm(F.col("text"))).join(items, "norm", "left_semi").select("doc_id")


@query("with b as (select lang, doc_id // 4096 as block, count(*) as n, sha256(string_agg(doc_id::varchar || chr(0) || coalesce(n_chars::varchar, ''), chr(0) order by doc_id)) as d from documents group by all) select sum(n)::bigint as n, sha256(string_agg(d, chr(0) order by block)) as digest, lang from b group by lang")
def ordered_digest(spark: SparkSession, d: str) -> DataFrame:
    return layers.ordered_digest(table(spark, d, "documents"), ["lang"], "doc_id", "n_chars").select("n", "digest", "lang")


@query(f"""with d as (select doc_id, {T3} as t from documents), b as (select item_id, {T3} as q from benchmark), p as (select item_id, doc_id, len(q) as n, list_intersect(q, t) as m from d, b)
select item_id, doc_id, case when len(m) / n >= 0.6 then 2 when len(m) / n >= 0.3 then 1 else 0 end as suggested, array_to_string(list_slice(list_sort(m), 1, 12), ' ') as matched from p where len(m) > 0""")
def label_suggestion(spark: SparkSession, d: str) -> DataFrame:
    """Every question against every document with one of its terms; any other pair has label 0 and no match."""
    q = _questions(spark, d).select("item_id", X.annotation_terms(F.col("text")).alias("q")).select("item_id", F.size("q").alias("n"), F.explode("q").alias("term"))
    t = retrieve.terms(table(spark, d, "documents"), "doc_id", X.annotation_terms(F.col("text")))
    hits = t.join(F.broadcast(q) if retrieve._few(q) else q, "term").groupBy("item_id", "doc_id").agg(F.first("n").alias("n"), F.array_sort(F.collect_set("term")).alias("m"))
    share = F.size("m").cast("double") / F.col("n")
    label = F.when(share >= 0.6, 2).when(share >= 0.3, 1).otherwise(0)
    return hits.select("item_id", "doc_id", label.alias("suggested"), F.array_join(F.slice("m", 1, 12), " ").alias("matched"))


@query(f"""with {CHUNKS}, {Q_TERMS}, {C_TERMS}, n as (select count(*) as n from uniq), f as (select w.term, count(c.chunk_id) as df from (select distinct term from q) w left join c using (term) group by w.term),
wq as (select item_id, q.term, ln((n + 1.0) / (df + 1.0)) + 1.0 as w from q join f using (term), n), tot as (select item_id, count(*) as n, sum(w) as total from wq group by item_id),
h as (select item_id, chunk_id, count(*) as m, sum(w) as hit from wq join c using (term) group by all)
select item_id, chunk_id, m::bigint as matched, round(least(1.0, 0.5 * m / tot.n + 0.5 * hit / total), 9) as support from h join tot using (item_id)""")
def support_sigma(spark: SparkSession, d: str) -> DataFrame:
    """M01 for every question and chunk that share a term; all other pairs have support 0."""
    from lodestar.operators import admit

    q = _q_terms(spark, d)
    wanted = q.select("term").distinct()
    unique = write_once(_unique_chunks(spark, d).select("chunk_id", F.array_distinct(X.policy_tokens(F.col("text"))).alias("terms")), "chunk-terms")
    size = unique.agg(F.count(F.lit(1)).alias("corpus"))
    hits = unique.select("chunk_id", F.explode("terms").alias("term")).join(F.broadcast(wanted) if retrieve._few(q) else wanted, "term", "left_semi")
    hits = write_once(hits, "hits")
    frequency = retrieve.document_frequency(hits, wanted).crossJoin(F.broadcast(size))
    return admit.support_of_matches(q, hits.repartition(retrieve.pair_parts(hits, q), "chunk_id"), frequency, "item_id", "chunk_id", F.col("corpus"))


LINES = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""with b as (select distinct unnest(string_split(text, chr(10))) as l from benchmark), n as (select {LINES.format('l')} as norm from b), d as (select doc_id, unnest(string_split(text, chr(10))) as l from documents)
select doc_id, count(*)::bigint as lines from d where length({LINES.format('l')}) >= 40 and {LINES.format('l')} in (select norm from n) group by doc_id""")
def leakage_lines(spark: SparkSession, d: str) -> DataFrame:
    """Q12: documents that hold whole lines of the benchmark."""
    lines = lambda df, *c: df.select(*c, F.explode(F.split("text", "\n")).alias("l")).select(*c, X.question_norm(F.col("l")).alias("norm"))
    items = lines(_questions(spark, d)).distinct()
    held = lines(table(spark, d, "documents"), "doc_id").where(F.length("norm") >= 40)
    return held.join(items, "norm", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


STUB = "(('0x' || substr(sha256({}), 1, 12))::bigint / 281474976710656.0)"
SAID = "['A', 'B', 'C', 'D'][(floor(" + STUB + " * 4) + 1)::int]"


@query(f"""{LEXICAL}, top as (select ranked.item_id, rank, uniq.text, b.text as question from ranked join uniq using (chunk_id) join benchmark b using (item_id) where rank <= 5),
f as (select *, {STUB.format("question || chr(0) || text")} >= 0.7 as own from top), k as (select *, own or (max(own::int) over (partition by item_id) = 0 and rank = 1) as kept, max(own::int) over (partition by item_id) = 0 as empty from f),
ctx as (select item_id, any_value(question) as question, any_value(empty) as fell_back, count(*)::bigint as passages, string_agg('[' || i || '] ' || text, chr(10) order by i) as context from (select *, row_number() over (partition by item_id order by rank) as i from k where kept) group by item_id),
g as (select *, {SAID.format("'Question: ' || question || chr(10) || 'Evidence: ' || context || chr(10) || 'Answer:'")} as choice, ['A', 'B', 'C', 'D'][(item_id % 4) + 1] as gold from ctx)
select item_id, passages, fell_back, choice, gold, choice = gold as correct from g""")
def answer_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """retrieve, filter with a fallback, put the evidence into a prompt, generate, extract the letter, compare with the gold one."""
    from lodestar.functions import records
    from lodestar.operators import model, select

    best = retrieve.lexical(_q_terms(spark, d), _c_terms(spark, d), "item_id", "chunk_id", DEPTH).where("rank <= 5").select("item_id", "chunk_id", "rank")
    asked = _questions(spark, d).select("item_id", F.col("text").alias("question"))
    rows = _chunks(spark, d).select("chunk_id", "text").join(F.broadcast(best) if retrieve._few(_questions(spark, d)) else best, "chunk_id").join(asked, "item_id")
    rows = rows.withColumn("kept", model.stub_probability(F.col("question"), F.col("text")) >= 0.7)
    kept = select.with_fallback(rows, "item_id", "rank", "kept", "keep_top1").where("kept")
    evidence = retrieve.context(kept, "item_id", "rank", "text").join(asked, "item_id")
    fell = kept.groupBy("item_id").agg(F.max(F.col("fallback").isNotNull()).alias("fell_back"))
    prompt = X.fill("Question: {question}\nEvidence: {context}\nAnswer:", question=F.col("question"), context=F.col("context"))
    said = evidence.join(fell, "item_id").withColumn("generated", model.generate("stub", prompt)).withColumn("choice", X.choice(F.col("generated")))
    gold = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("item_id") % 4 + 1).cast("int"))
    return said.select("item_id", F.col("n_passages").alias("passages"), "fell_back", "choice", gold.alias("gold"), records.correct(F.col("choice"), gold).alias("correct"))


@query(f"""{LEXICAL}, top as (select ranked.item_id, chunk_id, rank, uniq.text, b.text as question, ['A', 'B', 'C', 'D'][(item_id % 4) + 1] as gold from ranked join uniq using (chunk_id) join benchmark b using (item_id) where rank <= 5),
o as (select item_id, chunk_id, {SAID.format("question")} = gold as closed, {SAID.format("question || chr(10) || text")} = gold as helped, round({STUB.format("question || chr(0) || text")} - {STUB.format("question")}, 9) as delta from top)
select item_id, chunk_id, closed, helped, delta, case when closed and not helped then 'DISCARD' when delta >= 0.1 then 'HELPFUL' else 'NOT_HELPFUL' end as label from o""")
def observations(spark: SparkSession, d: str) -> DataFrame:
    """Each pair answered without and with its passage and scored twice, then labelled."""
    from lodestar.operators import compare, model

    best = retrieve.lexical(_q_terms(spark, d), _c_terms(spark, d), "item_id", "chunk_id", DEPTH).where("rank <= 5").select("item_id", "chunk_id")
    gold = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("item_id") % 4 + 1).cast("int"))
    asked = _questions(spark, d).select("item_id", F.col("text").alias("question"), gold.alias("gold")).withColumns({"closed": model.stub_choice(F.col("question")) == F.col("gold"), "alone": model.stub_probability(F.col("question"))})
    rows = _chunks(spark, d).select("chunk_id", "text").join(F.broadcast(best) if retrieve._few(_questions(spark, d)) else best, "chunk_id").join(asked, "item_id")
    helped = model.stub_choice(F.concat_ws("\n", "question", "text")) == F.col("gold")
    delta = F.round(model.stub_probability(F.col("question"), F.col("text")) - F.col("alone"), 9)
    rows = rows.select("item_id", "chunk_id", "closed", helped.alias("helped"), delta.alias("delta"))
    return rows.withColumn("label", compare.label_tree(F.col("closed"), F.col("helped"), F.col("delta"), F.lit(0.1)))


@query("select item_id, 'Question: ' || coalesce(trim(text), '') || chr(10) || 'Answer:' as prompt, substr(sha256('Question: {question}' || chr(10) || 'Answer:'), 1, 12) as fingerprint from benchmark")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    template = "Question: {question}\nAnswer:"
    return _questions(spark, d).select("item_id", X.fill(template, question=X.retrieval_query(F.lit(" "), F.col("text"))).alias("prompt"), F.substring(F.sha2(F.lit(template), 256), 1, 12).alias("fingerprint"))
