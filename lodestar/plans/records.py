"""Queries over records: sections, notices, licences, dates, options and answers, built from the rows of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalog import query, table
from lodestar.functions import licences
from lodestar.functions import records as R
from lodestar.functions import text as X
from lodestar.plans.labels import sentences_sql

TITLES = ["Materials and Methods", "Results:", " Discussion.", "Conclusions", "Background", "Supplementary material", "Conflict of interest", "Study design", "Patient cohort", "Funding"]
TYPES = ["intro", "methods", "results", "discussion", "coi-statement", "", "subjects|methods", "other", "funding", "conclusion", "background"]


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _pick(words: list[str], key: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.col(key) % len(words) + 1).cast("int"))


SECTION = f"s as (select p_partkey as id, {_quoted(TITLES)}[(p_partkey % {len(TITLES)}) + 1] || case when p_partkey % 3 = 0 then ' ' || p_name else '' end as title, {_quoted(TYPES)}[(p_partkey % {len(TYPES)}) + 1] as kind, case when p_size > 25 then 'results' else '' end as parent from part)"
NORM_TITLE = "lower(regexp_replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), '^[ .:]+|[ .:]+$', '', 'g'))"


def _sections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    title = F.concat(_pick(TITLES, "id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit(" "), F.col("p_name"))).otherwise(""))
    return rows.select("id", title.alias("title"), _pick(TYPES, "id").alias("kind"), F.when(F.col("p_size") > 25, "results").otherwise("").alias("parent"))


@query(f"""with {SECTION}, n as (select *, {NORM_TITLE} as t from s), c as (select *, case {' '.join(f"when regexp_matches(t, '{p}') then '{k}'" for k, p in R.SECTION_TITLES)} end as bt,
case lower(trim(kind)) {' '.join(f"when '{k}' then '{v}'" for k, v in R.SECTION_TYPES.items())} end as bk from n)
select id, coalesce(bt, bk, nullif(parent, ''), 'other') as class, case when bt is not null then 'title_match' when bk is not null then 'sec_type' when parent <> '' then 'inherited' else 'unknown' end as origin,
lower(trim(kind)) not in ({', '.join(f"'{k}'" for k in R.NO_CONTENT_TYPES)}) and not regexp_matches(t, '{'|'.join(R.NO_CONTENT_TITLES)}') as content from c""")
def section_class(spark: SparkSession, d: str) -> DataFrame:
    """What a section is, how that is known, and whether it matters."""
    rows = _sections(spark, d)
    name, origin = R.section_class(F.col("title"), F.col("kind"), F.col("parent"))
    return rows.select("id", name.alias("class"), origin.alias("origin"), R.is_content(F.col("title"), F.col("kind")).alias("content"))


WORDS = "len(regexp_extract_all(coalesce(text, ''), '\\S+'))"


@query(f"""with r as (select doc_id, text, lang, source, {WORDS} as words from documents), f as (select doc_id, case when text is null then 'no_body' when words < 250 then 'stub' when coalesce(lang, '') = '' then 'no_abstract' else 'ok' end as status,
list_filter([case when not contains(text, chr(10)) then 'no_sections' end, case when doc_id % 6 = 0 then 'no_references' end, case when source is null then 'no_authors' end, case when doc_id % 4 = 1 then 'partial_date' end, case when lang is null then 'no_date' end, case when regexp_matches(text, '[0-9]{{4}}') then 'has_year' end], lambda x: x is not null) as fl from r)
select doc_id, status, array_to_string(fl, ';') as flags from f""")
def qc_status_flags(spark: SparkSession, d: str) -> DataFrame:
    """Status by precedence and an ordered list of flags."""
    rows, t = table(spark, d, "documents"), F.col("text")
    status = R.qc_status(t.isNotNull(), X.word_count(t), F.col("lang"))
    found = R.flags({"no_sections": ~F.contains(t, F.lit("\n")), "no_references": F.col("doc_id") % 6 == 0, "no_authors": F.col("source").isNull(), "partial_date": F.col("doc_id") % 4 == 1, "no_date": F.col("lang").isNull(), "has_year": t.rlike("[0-9]{4}")})
    return rows.select("doc_id", status.alias("status"), F.array_join(found, ";").alias("flags"))


EVIDENCE = """e as (select page_id as id, page_id % 9 <> 0 as given, case page_id % 5 when 0 then 'https://creativecommons.org/licenses/by/4.0/' when 1 then 'publisher terms' else '' end as ref, case page_id % 7 when 2 then 'ccbylicense' when 3 then 'cc0license' else '' end as kind,
case page_id % 4 when 1 then 'Text and data mining is allowed. ' else '' end || coalesce(html, '') as prose, case page_id % 3 when 0 then 'TDM permitted' when 1 then 'c 2020' else '' end as stmt from pages)"""


@query(f"""with {EVIDENCE} select id, case when given and (regexp_matches(ref, '{R.CC_URL}') or regexp_matches(prose, '{R.CC_URL}') or regexp_matches(kind, '{R.CC_TYPE}')) then 'A' when regexp_matches(case when given then prose else stmt end, '{R.TDM_PROSE}') then 'C' when given then 'B' else 'D' end as tier from e""")
def licence_tier(spark: SparkSession, d: str) -> DataFrame:
    """What a source's permissions are evidence of."""
    k = F.col("page_id")
    rows = table(spark, d, "pages").select(
        k.alias("id"), (k % 9 != 0).alias("given"), F.when(k % 5 == 0, "https://creativecommons.org/licenses/by/4.0/").when(k % 5 == 1, "publisher terms").otherwise("").alias("ref"), F.when(k % 7 == 2, "ccbylicense").when(k % 7 == 3, "cc0license").otherwise("").alias("kind"),
        F.concat(F.when(k % 4 == 1, "Text and data mining is allowed. ").otherwise(""), F.coalesce("html", F.lit(""))).alias("prose"), F.when(k % 3 == 0, "TDM permitted").when(k % 3 == 1, "c 2020").otherwise("").alias("stmt"),
    )
    return rows.select("id", R.licence_tier(*[F.col(c) for c in ("given", "ref", "kind", "prose", "stmt")]).alias("tier"))


JOURNALS, KINDS, HEADS = ["Neurology", " bioRxiv", "Brain", "SSRN "], ["research-article", "letter", "case-report", "retraction", "other"], ["Correction to a paper", "A study of it", "Editorial", "Reply to X"]
STUB = f"""r as (select doc_id, {_quoted(JOURNALS)}[(doc_id % 4) + 1] as journal, {_quoted(KINDS)}[(doc_id % 5) + 1] as kind, {_quoted(HEADS)}[(doc_id % 7 % 4) + 1] || ' ' || doc_id as title, case when doc_id % 11 = 0 then 'The authors do not permit archiving. ' else '' end || coalesce(text, '') as body,
{WORDS} as words, case when doc_id % 13 = 0 then 0 else 3 end as sections, doc_id % 3 as refs, coalesce(lang, '') as abstract from documents),
st as (select *, case when regexp_matches(body, '{R.PLACEHOLDER}') or lower(trim(journal)) in ({', '.join(f"'{j}'" for j in R.PREPRINT_JOURNALS)}) then 'placeholder' when kind in ({', '.join(f"'{j}'" for j in R.NOTICE_TYPES)}) or regexp_matches(title, '{R.NOTICE_TITLE}') then 'notice' when sections = 0 then 'incomplete'
when words >= 100 and refs > 0 and abstract <> '' and kind in ({', '.join(f"'{j}'" for j in R.SUBSTANTIVE_TYPES)}) then 'short publication' else 'manual review' end as stub from r)"""


def _stubs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = table(spark, d, "documents").withColumn("k7", k % 7)
    body = F.concat(F.when(k % 11 == 0, "The authors do not permit archiving. ").otherwise(""), F.coalesce("text", F.lit("")))
    stub = R.stub_class(F.concat(_pick(HEADS, "k7"), F.lit(" "), k.cast("string")), _pick(JOURNALS, "doc_id"), _pick(KINDS, "doc_id"), body, X.word_count(F.col("text")), F.when(k % 13 == 0, 0).otherwise(3), k % 3, F.coalesce("lang", F.lit("")))
    return rows.select("doc_id", stub.alias("stub"))


@query(f"with {STUB} select doc_id, stub from st")
def stub_class(spark: SparkSession, d: str) -> DataFrame:
    """X24."""
    return _stubs(spark, d)


PROBLEMS = ["license_absent", "no_doi", "license_disagreement", "no_sections", "stub"]


@query(f"""with {STUB} select doc_id, {_quoted(PROBLEMS)}[(doc_id % 5) + 1] as "group", case when doc_id % 17 = 0 then 'bug' when doc_id % 19 = 0 then 'possible' when doc_id % 5 = 0 and doc_id % 2 = 0 then 'possible' when stub = 'manual review' then 'review' when stub in ('placeholder', 'notice') then 'legitimate' when stub = 'incomplete' then 'unusual' when doc_id % 5 in (2, 3) then 'review' else 'legitimate' end as category from st""")
def anomaly_category(spark: SparkSession, d: str) -> DataFrame:
    """One category for each problem record, by precedence."""
    k = F.col("doc_id")
    group = _pick(PROBLEMS, "doc_id")
    return _stubs(spark, d).select("doc_id", group.alias("group"), R.anomaly(group, k % 17 == 0, k % 19 == 0, F.when(k % 2 == 0, "A").otherwise("B"), F.col("stub")).alias("category"))


@query("""with m as (select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as dd, strftime(o_orderdate, '%Y-%m') as mm, strftime(o_orderdate, '%Y') as yy, o_orderkey as k from orders),
c as (select id, case when k % 2 = 0 then '' else dd end as epub, case when k % 3 = 0 then mm end as ppub, case when k % 5 = 0 then yy else ' ' end as collection, case when k % 7 < 5 then dd end as accepted, dd as preprint from m)
select id, coalesce(nullif(trim(epub), ''), nullif(trim(ppub), ''), nullif(trim(collection), ''), nullif(trim(accepted), '')) as date, case when trim(epub) <> '' then 'epub' when trim(ppub) <> '' then 'ppub' when trim(collection) <> '' then 'collection' when trim(accepted) <> '' then 'accepted' end as kind from c""")
def date_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The canonical one of a record's dates."""
    k, f = F.col("o_orderkey"), lambda p: F.date_format("o_orderdate", p)
    pairs = {"preprint": f("yyyy-MM-dd"), "accepted": F.when(k % 7 < 5, f("yyyy-MM-dd")), "collection": F.when(k % 5 == 0, f("yyyy")).otherwise(" "), "ppub": F.when(k % 3 == 0, f("yyyy-MM")), "epub": F.when(k % 2 == 0, "").otherwise(f("yyyy-MM-dd"))}
    date, kind = R.canonical_date(F.create_map(*[x for n, v in pairs.items() for x in (F.lit(n), v)]))
    return table(spark, d, "orders").select(k.alias("id"), date.alias("date"), kind.alias("kind"))


FREE = "case o_orderkey % 6 when 0 then strftime(o_orderdate, '%Y %b-') || 'Dec' when 1 then strftime(o_orderdate, '%Y') || ' Winter' when 2 then strftime(o_orderdate, '%Y-%Y') when 3 then strftime(o_orderdate, '%Y %b ') || day(o_orderdate) when 4 then 'Vol. 12, ' || strftime(o_orderdate, '%Y %B %d') else 'n.d.' end"


@query(f"""with f as (select o_orderkey as id, o_orderdate as t, {FREE} as free from orders), p as (select id, free, case id % 6 when 0 then strftime(t, '%Y-%m') when 1 then strftime(t, '%Y') when 2 then strftime(t, '%Y') when 3 then strftime(t, '%Y-%m-%d') when 4 then strftime(t, '%Y-%m-%d') end as found from f)
select id, free, found, coalesce(found, '1900') as published from p""")
def free_text_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates read from free text, and the fallback to the next candidate."""
    k, f = F.col("o_orderkey") % 6, lambda p: F.date_format("o_orderdate", p)
    free = F.when(k == 0, F.concat(f("yyyy MMM"), F.lit("-Dec"))).when(k == 1, F.concat(f("yyyy"), F.lit(" Winter"))).when(k == 2, F.concat(f("yyyy"), F.lit("-"), f("yyyy")))
    free = free.when(k == 3, f("yyyy MMM d")).when(k == 4, F.concat(F.lit("Vol. 12, "), f("yyyy MMMM dd"))).otherwise("n.d.")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), free.alias("free")).withColumn("found", R.free_date(F.col("free")))
    return rows.withColumn("published", R.first_date(F.col("found"), F.lit("  "), F.lit("1900")))


@query(r"""with l as (select item_id, trim(regexp_replace(regexp_replace(text, '[()"]', '', 'g'), '\s+', ' ', 'g')) as t from benchmark)
select item_id, '(' || t || case when item_id % 3 = 1 then ' AND second' else '' end || ') AND ("2020/01/01"[Date - Publication] : "2024/12/31"[Date - Publication])' as term from l""")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    """A query block loses its own date filter and is scoped to a window."""
    t, k = F.regexp_replace("text", r'[()"]', ""), F.col("item_id") % 3
    old = F.lit('("2019/01/01"[Date - Publication] : "2019/12/31"[date - publication])')
    lines = F.when(k == 0, F.array(t, F.lit("AND"), old)).when(k == 1, F.array(t, F.lit("AND"), old, F.lit("AND second"))).otherwise(F.array(F.lit("AND"), old, F.lit("and"), t))
    return table(spark, d, "benchmark").select("item_id", R.query_term(lines, F.lit("2020/01/01"), F.lit("2024/12/31")).alias("term"))


@query("""select conv_id, turn, case when turn % 4 = 0 then text when turn % 4 = 1 then role || '. ' || text when turn % 4 = 2 then text else role end as text, 'c' || conv_id as doc_id, case when turn % 2 = 0 then 'p' || turn end as passage_id, 'user ' || role as extra from conversations where text is not null and text <> ''""")
def passage_decode(spark: SparkSession, d: str) -> DataFrame:
    """Records of several shapes as one."""
    k = F.col("turn") % 4
    rows = table(spark, d, "conversations").where("text is not null and text <> ''")
    name = F.when(k == 0, "content").when(k == 1, "body").otherwise("abstract")
    base = F.map_concat(F.create_map(F.lit("pmid"), F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("venue"), F.concat(F.lit("user "), F.col("role"))), F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("chunk_id"), F.concat(F.lit("p"), F.col("turn").cast("string")))).otherwise(F.create_map(F.lit("pid"), F.lit(""))))
    title = F.when(k == 1, F.col("role")).when(k == 2, F.substring("text", 1, 4)).when(k == 3, F.col("role")).otherwise("")
    record = F.map_concat(base, F.create_map(name, F.when(k == 3, "").otherwise(F.col("text")), F.lit("title"), title))
    got = R.decode_passage(record)
    return rows.select("conv_id", "turn", got["text"].alias("text"), got["doc_id"].alias("doc_id"), got["passage_id"].alias("passage_id"), F.try_element_at(got["metadata"], F.lit("venue")).alias("extra"))


@query("""with o as (select p_partkey as id, p_name as a, p_brand as b, p_type as c from part), s as (select *, case id % 3 when 0 then 'B' when 1 then '(a)' else 'c.' end as letter, (id % 4)::varchar as idx, case when id % 2 = 0 then c else 'none of them' end as words from o)
select id, 'A=' || a || ';B=' || b || ';C=' || c as options, case id % 3 when 0 then 'B' when 1 then null else 'C' end as by_letter, case id % 4 when 0 then 'A' when 1 then 'B' else 'C' end as by_index, case when id % 2 = 0 then case when c = a then 'A' when c = b then 'B' else 'C' end end as by_text from s""")
def option_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Options of three shapes as one, and gold answers of three styles."""
    k, abc = F.col("p_partkey"), [F.col(c) for c in ("p_name", "p_brand", "p_type")]
    keyed = lambda keys: R.options_by_letter(F.create_map(*[x for n, v in zip(keys, abc, strict=True) for x in (F.lit(n), v)]))
    options = F.when(k % 3 == 0, keyed(["a", "b", "c"])).when(k % 3 == 1, keyed(["op_a", "op_b", "op_c"])).otherwise(R.options_of_list(F.array(*abc)))
    rows = table(spark, d, "part").select(k.alias("id"), options.alias("o"), F.when(k % 3 == 0, "B").when(k % 3 == 1, "(a)").otherwise("c.").alias("letter"), (k % 4).cast("string").alias("idx"), F.when(k % 2 == 0, F.col("p_type")).otherwise("none of them").alias("words"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("o")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    answer = lambda c, style: R.answer_letter(F.col(c), F.col("o"), style)
    return rows.select("id", shown.alias("options"), answer("letter", "letter").alias("by_letter"), answer("idx", "index").alias("by_index"), answer("words", "text").alias("by_text"))


@query("""select c_custkey, substr(sha256('{"key": ' || c_custkey || ', "name": "' || c_name || '", "segment": ' || coalesce('"' || c_mktsegment || '"', 'null') || '}'), 1, 12) as hash from customer""")
def stable_hash(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of a record with sorted keys and values that JSON can hold."""
    payload = R.sorted_json({"segment": R.json_text(F.col("c_mktsegment")), "key": F.col("c_custkey").cast("string"), "name": R.json_text(F.col("c_name"))})
    return table(spark, d, "customer").select("c_custkey", R.stable_hash(payload).alias("hash"))


@query("with p as (select page_id, regexp_extract(url, '^[^?#]*') as path from pages) select page_id, array_to_string(list_slice(string_split(path, '/'), greatest(len(string_split(path, '/')) - 1, 1), len(string_split(path, '/'))), '/') as tail from p")
def path_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last two components of a path, whichever slash it has."""
    path = F.regexp_extract("url", r"^[^?#]*", 0)
    mixed = F.when(F.col("page_id") % 2 == 0, F.replace(path, F.lit("/"), F.lit("\\"))).otherwise(path)
    return table(spark, d, "pages").select("page_id", R.last_components(mixed).alias("tail"))


@query("select event_id, case when event_id % 3 = 0 then '' when value > 50 then 'yes' else 'no' end as dear from events")
def tri_state(spark: SparkSession, d: str) -> DataFrame:
    """P21."""
    return table(spark, d, "events").select("event_id", R.tri_state(F.when(F.col("event_id") % 3 != 0, F.col("value") > 50)).alias("dear"))


@query(f"select item_id, array_to_string(list_filter({sentences_sql('text')}, lambda s: length(trim(s)) > 1), ' [SEP] ') as marked from benchmark")
def separated_sentences(spark: SparkSession, d: str) -> DataFrame:
    """What a cross-encoder reads."""
    return table(spark, d, "benchmark").select("item_id", R.separated(licences.sentences(F.col("text"))).alias("marked"))


@query("""select 'labels' as source, 'quality' as field, count(quality)::bigint as filled from labels union all select 'labels', 'toxic', count(toxic)::bigint from labels""")
def answer_target_fields(spark: SparkSession, d: str) -> DataFrame:
    """Which tables carry something to measure answers against."""
    found = None
    for name in ("benchmark", "conversations", "labels"):
        rows = table(spark, d, name)
        for field in R.target_fields(rows.columns, ["gold", "reference", "quality", "ground_truth"], ["answer", "answers", "options", "choices", "toxic"]):
            one = rows.agg(F.count(field).alias("filled")).select(F.lit(name).alias("source"), F.lit(field).alias("field"), "filled")
            found = one if found is None else found.union(one)
    return found


ANSWERS = ["The answer is a well known fact, (C)", "answer: b) I think", "Option D is right, not (A)", "B. because of it", "I would say C", "surely the red one", "no idea at all", "The answer is (B). Not option E."]
EXPECTED = ["'C'", "'B'", "'D'", "'B'", "'C'", "'D'", "'A'", "'B'"]


@query(f"""select conv_id, turn, [{', '.join(EXPECTED)}][((conv_id + turn) % 8) + 1] as choice, [{', '.join(EXPECTED)}][((conv_id + turn) % 8) + 1] = chr(65 + (turn % 4)::int) as right from conversations""")
def choice_with_options(spark: SparkSession, d: str) -> DataFrame:
    """Phrases in order, lone letters, then the option's own words; and whether the choice is right."""
    options = F.create_map(*[F.lit(x) for kv in {"A": "idea", "B": "green", "C": "blue", "D": "red"}.items() for x in kv])
    rows = table(spark, d, "conversations").withColumn("k", F.col("conv_id") + F.col("turn"))
    letter = X.choice(_pick(ANSWERS, "k"), options)
    return rows.select("conv_id", "turn", letter.alias("choice"), R.correct(letter, F.char(65 + F.col("turn").cast("int") % 4)).alias("right"))


NEED = "regexp_replace(regexp_replace(text, '[^A-Za-z ]', '', 'g'), '\\s+', ' ', 'g')"


@query(f"""with b as (select item_id, trim({NEED}) as t from benchmark), g as (select *, length(t) between 15 and 220 and len(string_split(t, ' ')) >= 4 and not list_contains({_quoted(X.DANGLING)}, lower(list_extract(string_split(t, ' '), -1))) as good from b)
select item_id, case when q then t || '?' when good then t end as need, case when q then 'title_question' when good then 'objective_np' end as method from (select *, item_id % 3 = 0 and length(t || '?') between 15 and 220 as q from g)""")
def information_needs(spark: SparkSession, d: str) -> DataFrame:
    """What a document says that it asks."""
    t = F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z ]", ""), r"\s+", " "))
    k = F.col("item_id") % 3
    title = F.when(k == 0, F.concat(t, F.lit(" ?"[1:]))).otherwise("A plain title")
    body = F.when(k == 1, F.concat(F.lit("Before it. OBJECTIVE: To assess "), t, F.lit(". More of it."))).otherwise(F.concat(F.lit("Some words first. In this work we aimed to measure "), t, F.lit(". And then.")))
    first = lambda c: F.get(licences.sentences(c), F.lit(0))
    need, method = X.information_need(title, body, first)
    return table(spark, d, "benchmark").select("item_id", need.alias("need"), method.alias("method"))


def _xml(text: F.Column) -> F.Column:
    """Text fit for an element: no control characters, no marks."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F&<>]", " "), r"\s+", " ")


XML_TEXT = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F&<>]', ' ', 'g'), '\\s+', ' ', 'g'))"
XML_WORDS = f"len(list_filter(string_split({XML_TEXT}, ' '), lambda w: w <> ''))"


@query(f"""with r as (select doc_id, lang, source, {XML_WORDS} as w from documents)
select doc_id::varchar as id, case when doc_id % 11 = 0 then 'parse_error' when doc_id % 5 = 0 then 'no_body' else 'ok' end as status, case when doc_id % 11 <> 0 then '10.1/' || doc_id end as doi, case when doc_id % 11 <> 0 then 'Title of ' || doc_id end as title, case when doc_id % 11 <> 0 then 'Ann Lee;Group ' || coalesce(lang, 'x') end as authors,
case when doc_id % 11 <> 0 then 2 end as affiliations, case when doc_id % 11 <> 0 then 'The plain one' end as abstract, case when doc_id % 11 <> 0 then case when doc_id % 3 = 0 then '2020-03-07' else '2019' end end as published,
case when doc_id % 11 <> 0 then case when doc_id % 5 = 0 then 0 else w end end::bigint as body_words, case when doc_id % 11 <> 0 then case when doc_id % 5 = 0 then 0 else 2 end end as sections, case when doc_id % 11 <> 0 then 2 end as "references" from r""")
def article_records(spark: SparkSession, d: str) -> DataFrame:
    """X29, X30 (and D04 on what they find): articles written around the documents' texts, some of them broken, read back."""
    from lodestar.sources import articles

    k = F.col("doc_id")
    rows = table(spark, d, "documents")
    person = "<contrib contrib-type='author'><name><surname>Lee</surname><given-names>Ann</given-names></name></contrib><contrib contrib-type='editor'><name><surname>Ed</surname></name></contrib>"
    head = F.concat(
        F.lit("<article xmlns:xlink='http://www.w3.org/1999/xlink'><front><article-meta><article-id pub-id-type='doi'>10.1/"), k.cast("string"), F.lit("</article-id><title-group><article-title>Title <italic>of</italic> "), k.cast("string"),
        F.lit(f"</article-title></title-group><contrib-group>{person}<contrib><collab>Group "), F.coalesce("lang", F.lit("x")), F.lit("</collab></contrib><aff>A</aff></contrib-group><aff>B</aff>"),
        F.when(k % 3 == 0, "<pub-date pub-type='epub'><day>7</day><month>3</month><year>2020</year></pub-date>").otherwise(""), F.lit("<pub-date pub-type='ppub'><year>2019</year></pub-date><pub-date pub-type='preprint'><year>1999</year></pub-date>"),
        F.lit("<abstract abstract-type='graphical'><p>A picture</p></abstract><abstract><p>The plain one</p></abstract></article-meta></front>"),
    )
    body = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("<body><sec><title>One</title><sec><p>"), _xml(F.col("text")), F.lit("</p></sec></sec></body>")))
    tail = F.lit("<back><ref-list><ref id='r1'/><ref id='r2'/><ref id='r1'/></ref-list></back><sub-article><back><ref-list><ref id='z'/></ref-list></back></sub-article>")
    end = F.when(k % 11 == 0, "<broken").otherwise("</article>")
    found = articles.articles(rows.select(k.alias("id"), F.concat(head, body, tail, end).alias("markup")))
    published, _ = R.canonical_date(F.col("dates"))
    return found.select("id", "status", "doi", "title", F.array_join("authors", ";").alias("authors"), "affiliations", "abstract", published.alias("published"), "body_words", "sections", "references")


@query("""with r as (select o_orderkey as k, o_orderdate as t, o_orderpriority as p from orders)
select k::varchar as id, case when k % 13 = 0 then 'parse_error' else 'ok' end as status, case when k % 13 <> 0 then 'T ' || p end as title, case when k % 13 <> 0 then 'AIM: to see' || chr(10) || 'no label' end as abstract, case when k % 13 <> 0 then case when k % 4 = 0 then 'Ann B Lee' else 'Ann B Lee;The Group' end end as authors,
case when k % 13 <> 0 then 'Brain*/genetics;Mice' end as mesh, case when k % 13 <> 0 then case when k % 2 = 0 then '10.2/e' else '10.2/h' end end as doi, case when k % 13 = 0 then null when k % 3 = 0 then strftime(t, '%Y-%m-%d') when k % 3 = 1 then strftime(t, '%Y-%m') else '2001-02-03' end as published from r""")
def citation_records(spark: SparkSession, d: str) -> DataFrame:
    """Bibliography records with labelled abstracts, headings, ids and dates of three kinds."""
    from lodestar.functions import dates
    from lodestar.sources import articles

    k, f = F.col("o_orderkey"), lambda p: F.date_format("o_orderdate", p)
    issue = F.when(k % 3 == 0, F.concat(F.lit("<PubDate><Year>"), f("yyyy"), F.lit("</Year><Month>"), f("MMM"), F.lit("</Month><Day>"), f("d"), F.lit("</Day></PubDate>"))).when(k % 3 == 1, F.concat(F.lit("<PubDate><MedlineDate>"), f("yyyy MMM"), F.lit("-Dec</MedlineDate></PubDate>"))).otherwise("<PubDate/>")
    markup = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><Article><Journal><JournalIssue>"), issue, F.lit("</JournalIssue><Title>J</Title></Journal><ArticleTitle>T "), F.regexp_replace("o_orderpriority", "[&<>]", " "),
        F.lit("</ArticleTitle>"), F.when(k % 2 == 0, "<ELocationID EIdType='doi'>10.2/e</ELocationID>").otherwise(""),
        F.lit("<Abstract><AbstractText Label='AIM'>to <b>see</b></AbstractText><AbstractText/><AbstractText>no label</AbstractText></Abstract><AuthorList><Author><LastName>Lee</LastName><ForeName>Ann B</ForeName></Author>"),
        F.when(k % 4 == 0, "").otherwise("<Author><CollectiveName>The Group</CollectiveName></Author>"),
        F.lit("</AuthorList></Article><MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN='Y'>Brain</DescriptorName><QualifierName>genetics</QualifierName></MeshHeading><MeshHeading><DescriptorName>Mice</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>"),
        F.lit("<PubmedData><History><PubMedPubDate PubStatus='entrez'><Year>2005</Year></PubMedPubDate><PubMedPubDate PubStatus='pubmed'><Year>2001</Year><Month>2</Month><Day>3</Day></PubMedPubDate></History><ArticleIdList><ArticleId IdType='doi'>10.2/h</ArticleId></ArticleIdList></PubmedData>"),
        F.when(k % 13 == 0, "<").otherwise("</PubmedArticle>"),
    )
    found = articles.citations(table(spark, d, "orders").select(k.alias("id"), markup.alias("markup")))
    number = lambda c: F.nullif(F.trim(c), F.lit("")).cast("int")
    parts = dates.compose(number(F.col("year")), R.month_number(F.col("month")), number(F.col("day")))
    published = R.first_date(parts, R.free_date(F.col("free_date")))
    return found.select("id", "status", "title", "abstract", F.array_join("authors", ";").alias("authors"), F.array_join("mesh", ";").alias("mesh"), "doi", published.alias("published"))
