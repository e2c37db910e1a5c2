"""Queries over answers and markup: choices, ROUGE-L, splits, flattening, streaming counts."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.catalog import query, table
from lodestar.functions import text as X
from lodestar.operators import layers
from lodestar.session import shared_dir
from lodestar.sources import markup
from lodestar.streaming import ingest, labelling


@query(r"""with c as (select conv_id, turn, 'The answer is (' || chr(65 + (turn % 4)::int) || '). Not option ' || chr(65 + (conv_id % 4)::int) || '.' as answer from conversations) select conv_id, turn, upper(regexp_extract(answer, '(?i)answer\s+is\s*:?\s*\(?([ABCDE])\b', 1)) as choice from c""")
def choice_extract(spark: SparkSession, d: str) -> DataFrame:
    """X19 on answers rendered from each turn: the strongest phrase wins over a later, weaker one."""
    letter = lambda c: F.char(65 + c.cast("int") % 4)
    answer = F.concat(F.lit("The answer is ("), letter(F.col("turn")), F.lit("). Not option "), letter(F.col("conv_id")), F.lit("."))
    return table(spark, d, "conversations").select("conv_id", "turn", X.choice(answer).alias("choice"))


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@query()
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    """Each turn against the one before it, by longest common subsequence of words."""

    @F.pandas_udf("double")
    def f1(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = (x or "").split(), (y or "").split()
            n = _lcs(p, q)
            out.append(2 * n / (len(p) + len(q)) if n else 0.0)
        return pd.Series(out)

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").withColumn("before", before).where("before is not null")
    return rows.select("conv_id", "turn", F.round(f1("text", "before"), 9).alias("rouge_l"))


SPLIT = "o as (select conv_id, row_number() over (order by md5('42:' || conv_id), conv_id) as k, count(*) over () as n from (select distinct conv_id from conversations))"


@query(f"with {SPLIT} select c.conv_id, c.turn, case when k <= round(n * 0.8) then 'train' else 'test' end as split from conversations c join o using (conv_id)")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    """Whole groups by hash order; the groups' places come from a count of hash prefixes, not from one sorted task."""
    c = table(spark, d, "conversations")
    groups = c.select("conv_id").distinct().withColumn("h", F.md5(F.concat(F.lit("42:"), F.col("conv_id").cast("string")))).withColumn("p", F.substring("h", 1, 3))
    sizes = groups.groupBy("p").agg(F.count(F.lit(1)).alias("c"))  # at most 4,096 rows
    total = sizes.agg(F.sum("c").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "before")
    placed = groups.join(F.broadcast(before), "p").withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("h", "conv_id"))).crossJoin(F.broadcast(total))
    side = F.when(F.col("k") <= F.round(F.col("n") * 0.8), "train").otherwise("test")
    return c.join(placed.select("conv_id", side.alias("split")), "conv_id").select("conv_id", "turn", "split")


@query()
def html_flatten(spark: SparkSession, d: str) -> DataFrame:
    return markup.flatten(table(spark, d, "pages"))


@query()
def section_rows(spark: SparkSession, d: str) -> DataFrame:
    return markup.sections(table(spark, d, "pages"))


@query("select conv_id, string_agg('[' || role || '] ' || coalesce(text, ''), chr(10) order by turn) as transcript, count(*)::bigint as turns from conversations group by conv_id")
def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Turns nested again in order."""
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.coalesce("text", F.lit("")))
    turns = F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["l"]), "\n").alias("transcript"), F.count(F.lit(1)).alias("turns"))


@query("select time_bucket(interval '1 hour', ts) as bucket, event_type, count(*)::bigint as n, round(sum(value), 6) as total from events group by all")
def stream_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """A stream of the event files, counted in hourly windows with a watermark, run to its end."""
    return ingest.tumbling_counts(spark, f"{d}/events.parquet", f"{shared_dir(spark)}/lodestar/stream-{uuid.uuid4().hex}")


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by event_id order by ts) as k from events) where k = 1")
def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Keys seen before are dropped by the stream's state."""
    return ingest.deduplicated(spark, f"{d}/events.parquet", f"{shared_dir(spark)}/lodestar/stream-{uuid.uuid4().hex}").select("event_id", "user_id", "event_type")


@query("select user_id, count(*)::bigint as attempts, arg_max(event_type, (ts, event_id)) as state from events group by user_id")
def retry_state(spark: SparkSession, d: str) -> DataFrame:
    """The newest state of each key supersedes earlier ones."""
    e = table(spark, d, "events")
    newest = layers.last_wins(e.select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts")).join(newest, "user_id").select("user_id", "attempts", F.col("event_type").alias("state"))


VALID = ["view", "click", "purchase"]


@query(f"""with e as (select user_id, event_id as seq, event_type, event_type in ({', '.join(f"'{v}'" for v in VALID)}) as ok from events where user_id is not null and event_id is not null)
select user_id, seq, case when ok then 'accepted' else 'invalid' end as status, case when ok then null when event_type is null then 'no label' else 'unknown label ' || event_type end as reason,
 last_value(case when ok then event_type end ignore nulls) over (partition by user_id order by seq rows between unbounded preceding and 1 preceding) as previous,
 count(*) filter (where ok) over (partition by user_id order by seq)::bigint as accepted, count(*) filter (where ok is not true) over (partition by user_id order by seq) = 0 as in_prefix from e""")
def stream_labels(spark: SparkSession, d: str) -> DataFrame:
    """A stream of labels, each judged against its key's state."""
    stream = ingest._source(spark, f"{d}/events.parquet")
    return labelling.judged(stream, "user_id", "event_id", "event_type", VALID, f"{shared_dir(spark)}/lodestar/labels-{uuid.uuid4().hex}")
