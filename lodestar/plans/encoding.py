"""Queries of models over whole documents: the model is the share of different words, which SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalog import query, table
from lodestar.operators import encode

WIDTH, OVERLAP, LIMIT = 128, 32, 700
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"


def _diversity():
    """Different words over words; no call may hold more than LIMIT words, as a model on a small device."""

    def model(texts: list[list[str]]) -> list[float]:
        if sum(map(len, texts)) > LIMIT:
            raise MemoryError("too many words")
        return [len(set(t)) / len(t) if t else 0.0 for t in texts]

    return model


@query(rf"""with d as (select doc_id, {WORDS} as ws from documents)
select doc_id, case when len(ws) <= {LIMIT} then round(case when len(ws) = 0 then 0.0 else len(list_distinct(ws)) / len(ws) end, 9) end as value, case when len(ws) > {LIMIT} then 'MemoryError: too many words' end as error from d""")
def encoded_with_backoff(spark: SparkSession, d: str) -> DataFrame:
    """calls that are too large are halved; a document that is too large alone is a row with its error."""
    out = encode.encode(table(spark, d, "documents"), "doc_id", "text", _diversity)
    return out.select("doc_id", F.round("value", 9).alias("value"), "error")


@query(rf"""with d as (select row_number() over () as r, doc_id, {WORDS} as ws from documents),
w as (select r, doc_id, list_slice(ws, s + 1, s + {WIDTH}) as ws from (select *, unnest(generate_series(0, greatest(0, ceil((len(ws) - {WIDTH}) / {WIDTH - OVERLAP}))::bigint * {WIDTH - OVERLAP}, {WIDTH - OVERLAP})) as s from d))
select doc_id, round(max(case when len(ws) = 0 then 0.0 else len(list_distinct(ws)) / len(ws) end), 9) as value, count(*)::bigint as windows from w group by r, doc_id""")
def strided_scores(spark: SparkSession, d: str) -> DataFrame:
    """the best of a document's overlapping windows."""
    out = encode.strided(table(spark, d, "documents"), "doc_id", "text", _diversity, WIDTH, OVERLAP)
    return out.select("doc_id", F.round("value", 9).alias("value"), "windows")
