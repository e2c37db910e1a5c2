"""Queries over the vector index: exact top-k, quotas, shards, reranking.

The query set is every row whose id is divisible by EVERY, so it grows with the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalog import query, table
from lodestar.operators import layers, retrieve

K, EVERY = 5, 50
DOT = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: z[1]::double * z[2]::double))"
PAIRS = f"pairs as (select q.vec_id as query_id, e.vec_id as id, e.label, e.vec_id % 4 as shard, round({DOT}, 9) as score from embeddings q, embeddings e where q.vec_id % {EVERY} = 0)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    corpus = e.select(F.col("vec_id").alias("id"), "embedding", "label", (F.col("vec_id") % 4).alias("shard"))
    return e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), corpus


def _out(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("query_id", "id", *extra, F.round("score", 9).alias("score"), "rank")


@query(f"with {PAIRS} select query_id, id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from pairs qualify rank <= {K}")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return _out(retrieve.knn(*_sides(spark, d), K))


@query(f"with {PAIRS} select query_id, id, label, score, row_number() over (partition by query_id, label order by score desc, id)::int as rank from pairs qualify rank <= {K}")
def knn_balanced(spark: SparkSession, d: str) -> DataFrame:
    """The same quota from every corpus."""
    return _out(retrieve.knn(*_sides(spark, d), K, "label"), "label")


@query(f"with {PAIRS} select query_id, id, shard, score, row_number() over (partition by query_id, shard order by score desc, id)::int as rank from pairs qualify rank <= {K}")
def knn_shard_concat(spark: SparkSession, d: str) -> DataFrame:
    """W02, concat: each shard's own top-k, stacked."""
    return _out(retrieve.knn(*_sides(spark, d), K, "shard"), "shard")


@query(f"with {PAIRS} select query_id, id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from pairs qualify rank <= {K}")
def knn_shard_score(spark: SparkSession, d: str) -> DataFrame:
    """W02, score: the shards' heads merged, which is the search over all."""
    queries, corpus = _sides(spark, d)
    heads = [retrieve.knn(queries, corpus.where(F.col("shard") == s), K) for s in range(4)]
    return _out(retrieve.merge_shards(heads, ["query_id"], K))


@query(f"with {PAIRS} select query_id, id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from pairs qualify rank <= {K}")
def knn_native(spark: SparkSession, d: str) -> DataFrame:
    """Every query with every vector, ranked by the rounded score as the SQL states it."""
    return _out(retrieve.all_pairs(*_sides(spark, d), K))


POOL = f"{PAIRS}, pool as (select query_id, id, label, score, row_number() over (partition by query_id, label order by score desc, id)::int as r from pairs qualify r <= {K}), placed as (select *, row_number() over (partition by query_id order by label, r) as place from pool)"


@query(f"with {POOL} select query_id, id, row_number() over (partition by query_id order by score desc, place)::int as rerank_rank from placed")
def rerank_by_score(spark: SparkSession, d: str) -> DataFrame:
    pool = _out(retrieve.knn(*_sides(spark, d), K, "label"), "label").withColumn("place", F.struct("label", "rank"))
    return retrieve.rerank(pool, "query_id", "score", "place").select("query_id", "id", "rerank_rank")


@query(f"with {POOL} select query_id, id, (count(*) over (partition by query_id) - place + 1)::int as identity_score from placed")
def rerank_identity(spark: SparkSession, d: str) -> DataFrame:
    """The pool's own order as a score."""
    from pyspark.sql import Window

    pool = _out(retrieve.knn(*_sides(spark, d), K, "label"), "label")
    w = Window.partitionBy("query_id")
    place = F.row_number().over(w.orderBy("label", "rank"))
    return pool.select("query_id", "id", (F.count(F.lit(1)).over(w) - place + 1).cast("int").alias("identity_score"))


@query(f"with {POOL}, k as (select query_id, label, count(*) as n from (select *, row_number() over (partition by query_id order by score desc, place) as k from placed) where k <= 10 group by all) select label, sum(n)::bigint as kept, round(sum(n) / sum(sum(n)) over (), 9) as share from k group by label")
def corpus_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Which corpora the reranked top ten come from."""
    from pyspark.sql import Window

    pool = _out(retrieve.knn(*_sides(spark, d), K, "label"), "label").withColumn("place", F.struct("label", "rank"))
    per = retrieve.rerank(pool, "query_id", "score", "place", 10).groupBy("label").agg(F.count(F.lit(1)).alias("kept"))
    return per.withColumn("share", F.round(F.col("kept") / F.sum("kept").over(Window.partitionBy()), 9))


@query("select vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 9) as norm from embeddings")
def vector_norm_audit(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", "label", F.round(F.sqrt(retrieve.dot(v, v)), 9).alias("norm"))


@query("with b as (select label, vec_id // 4096 as block, count(*) as n, sha256(string_agg(vec_id::varchar || chr(0) || (label * 10)::varchar, chr(0) order by vec_id)) as d from embeddings group by all) select label, sum(n)::bigint as n, sha256(string_agg(d, chr(0) order by block)) as digest from b group by label")
def index_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("v", F.col("label") * 10)
    return layers.ordered_digest(rows, ["label"], "vec_id", "v").select("label", "n", "digest")
