"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import spread

from . import langid, pii, toxicity
from .collocations import collocations
from .line_dedup import line_dedup
from .line_frequency import line_frequency_filter
from .minhash import near_duplicates
from .packing import pack_documents
from .suffix_dedup import remove_repeats
from .time_tree import point_in_time
from .token_rollup import maintain
from .warc import archive_round_trip
from .winnowing import contaminated, find_overlaps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


@query
def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_frequency_filter(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "n_words_removed")


ORACLE_SQL["op1_line_frequency"] = r"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
g as (select r, i, list_aggregate(list_slice(ws, i, i + 4), 'string_agg', ' ') as g
      from (select r, ws, unnest(generate_series(1, greatest(len(ws) - 4, 0))) as i from w)),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1),
cov as (select r, count(distinct p) as n from (select r, unnest(generate_series(i, i + 4)) as p from rep) group by r),
l as (select r, source, i, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as n,
      regexp_replace(translate(array_to_string(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') as norm
      from (select r, source, generate_subscripts(string_split(t, chr(10)), 1) as i, unnest(string_split(t, chr(10))) as l from d)),
dup as (select r, count(*) - count(distinct l) as n from l where n > 0 group by r),
hosts as (select source, count(*) as docs from d group by source),
seen as (select source, norm, count(distinct r) as c from l where n > 0 group by source, norm),
bad as (select s.source, s.norm from seen s join hosts h on s.source is not distinct from h.source where s.c > 10 and s.c > h.docs * 0.005),
rem as (select l.r, count(*) as nl, sum(l.n) as nw from l join bad b on l.source is not distinct from b.source and l.norm = b.norm where l.n > 0 group by l.r),
f as (select d.doc_id, len(w.ws)::bigint as n_words, coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0)::bigint as word_chars,
      length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
      coalesce(rem.nl, 0)::bigint as n_lines_removed, coalesce(rem.nw, 0)::bigint as n_words_removed
      from d join w using (r) left join dup using (r) left join cov using (r) left join rem using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not (n_words > 0 and n_words - n_words_removed < 0.3 * n_words) as kept,
       n_lines_removed, n_words_removed
from f
"""


@query
def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


ORACLE_SQL["op7_winnowing"] = r"""
with d as (select row_number() over () as r, doc_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bw as (select distinct item_id, least(len(ws), 13) as n, array_to_string(list_slice(ws, i, i + least(len(ws), 13) - 1), ' ') as g
      from (select item_id, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) as i from b where len(ws) > 0)),
lens as (select distinct n from bw),
dw as (select r, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') as g
      from (select r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as i from d, lens where len(ws) >= n)),
o as (select dw.r, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
h as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(i, i + n - 1)) as p from o) group by r),
it as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from o group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join h using (r) left join it using (r)
"""


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = langid.fold(F.col("doc_id"), 4)
    model = langid.fit(docs.where(fold != 2))
    return langid.detect(docs, model, keep=["doc_id"]).withColumn("held_out", F.coalesce(fold == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL["op5_arc_to_warc"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by payload_digest)
select d.page_id, payload_bytes, d.payload_digest, case when f.first is null or f.first = d.page_id then 'response' else 'revisit' end as record_type,
       case when f.first <> d.page_id then f.first end as refers_to
from d left join f on d.payload_bytes >= 100 and d.payload_digest = f.payload_digest
"""


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"], with_kept=False)


@query
def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain(table(spark, sf_dir, "documents")).totals()


ORACLE_SQL["op6_token_rollup"] = r"""
with d as (select source, lang, coalesce(lang = 'en', false) as en, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n1,
      len(regexp_extract_all(coalesce(text, ''), '[.,;:!?]|[^\x20\x09-\x0D.,;:!?]+')) as n2 from documents)
select source, lang, case when en then 'words-v2' else 'words-v1' end as tokenizer, count(*)::bigint as documents, sum(case when en then n2 else n1 end)::bigint as tokens
from d where n1 > 0 group by all
"""


@query
def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(langid.fold(F.col("doc_id"), 5) != 0))
    held_out = F.coalesce(langid.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score(docs, model, keep=["doc_id"]).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted")


@query
def op10_semi_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"), keep=["doc_id"], with_text=False)


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op12_line_dedup"] = r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, doc_id, unnest(ls) as l, generate_subscripts(ls, 1) as i from d),
k as (select *, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
bad as (select key from k where length(key) >= 1 group by key having count(distinct r) >= 10)
select doc_id, count(*)::bigint as n_lines, count(b.key)::bigint as n_dropped, sha256(coalesce(string_agg(l, chr(10) order by i) filter (b.key is null), '')) as kept_sha256
from k left join bad b on k.key = b.key group by r, doc_id
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_collocations"] = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
total as (select lang, sum(len(ws))::bigint as n from w group by lang),
g as (select lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') as phrase
      from (select lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) as i from w, (values (1), (2), (3)) as v(k) where len(ws) >= k)),
f as (select lang, k, phrase, count(*) as f from g group by all),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k > 1 and f >= 10),
cut as (select lang, phrase, k, a, j, array_to_string(list_slice(ws, 1, j), ' ') as x, array_to_string(list_slice(ws, j + 1, k), ' ') as y from c, (values (1), (2)) as v(j) where j < k),
s as (select cut.lang, cut.phrase, a, j, l.f as l, r.f as r, ((1000000::hugeint * a::hugeint * a::hugeint) // (l.f::hugeint * r.f::hugeint))::bigint as score
      from cut join f as l on l.lang = cut.lang and l.phrase = cut.x join f as r on r.lang = cut.lang and r.phrase = cut.y),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
part as (select lang, a, array_to_string(list_slice(ws, b, b + 1), ' ') as phrase from c, (values (1), (2)) as v(b) where k = 3),
cover as (select lang, phrase, max(a) as longer from part group by all),
out as (select lang, phrase, a, l, r, n, score from best join total using (lang) left join cover using (lang, phrase) where longer is null or 100 * longer < 50 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from out
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""


@query
def op11_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, clicks, lines = (table(spark, sf_dir, name) for name in ("sales", "clicks", "sale_lines"))
    at = F.col("sold") + F.coalesce(F.crc32(F.col("sale_id").cast("string")) % 259_200, F.lit(0)) * 1_000_000
    return point_in_time(sales, clicks, lines, at)


ORACLE_SQL["op11_point_in_time"] = r"""
with c as (select row_number() over () as r, sale_id, client_id, total, sold_at, arrived_at, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(sale_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda u, i: xor(u >> 1, 3988292384 * (u & 1))))) as crc
      from sales where client_id is not null and sold_at is not null),
s as (select r, sale_id, client_id, epoch_us(sold_at) as sold, epoch_us(arrived_at) + 14400000000 as seen, coalesce(floor(100 * total + 0.5), 0)::bigint as cents, epoch_us(sold_at) + coalesce(crc % 259200, 0) * 1000000 as t from c),
k as (select client_id, click_id, epoch_us(ts) as ts, epoch_us(arrived_at) + 14400000000 as seen, coalesce(kind = 'purchase', false) as bought, coalesce(floor(100 * value + 0.5), 0)::bigint as cents from (select distinct * from clicks)),
p as (select r, sale_id, client_id, t, d, t - d * 86400000000 as since from s, (values (2), (14)) as v(d)),
lab as (select distinct a.r from s a join s b on a.client_id = b.client_id and b.sold > a.t and b.sold <= a.t + 604800000000),
kc as (select r, d, count(*) as n, count(*) filter (bought) as b, sum(cents) as c, list(click_id order by k.ts desc, click_id desc nulls last)[1] as latest
       from p join k on p.client_id = k.client_id and k.ts > since and k.ts <= t and k.seen <= t group by r, d),
ps as (select p.r, d, p.t, s.sale_id, s.cents from p join s on p.client_id = s.client_id and s.sold > since and s.sold <= p.t and s.seen <= p.t),
sc as (select r, d, count(*) as n, sum(cents) as c from ps group by r, d),
lc as (select r, d, count(*) as n, count(distinct item_id) as i, sum(coalesce(floor(100 * amount + 0.5), 0))::bigint as c from ps join sale_lines l on l.sale_id = ps.sale_id and epoch_us(l.shipped_at) <= t group by r, d)
select p.sale_id, p.d, p.t as t_us, lab.r is not null as label, coalesce(kc.n, 0)::bigint as n_clicks, coalesce(kc.b, 0)::bigint as n_purchases, coalesce(kc.c, 0)::bigint as click_cents, kc.latest as last_click_id,
       coalesce(sc.n, 0)::bigint as n_sales, coalesce(sc.c, 0)::bigint as sale_cents, coalesce(lc.n, 0)::bigint as n_lines, coalesce(lc.i, 0)::bigint as n_items, coalesce(lc.c, 0)::bigint as line_cents
from p left join lab using (r) left join kc using (r, d) left join sc using (r, d) left join lc using (r, d)
"""
