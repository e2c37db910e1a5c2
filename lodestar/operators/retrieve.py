"""Retrieval: lexical and BM25 ranking, exact top-k vectors, quotas, reranking."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.stored import write_once

#: Query sides above this many rows are not broadcast.
QUERY_ROWS = 100_000


def terms(df: DataFrame, id_: str, tokens: Column) -> DataFrame:
    """id and term, one row for each distinct token."""
    return df.select(id_, F.explode(F.array_distinct(tokens)).alias("term"))


def document_frequency(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """In how many documents each wanted term is; 0 for terms in none. docs, wanted: distinct (id, term), term."""
    counts = docs.join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return wanted.join(counts, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order; Spark cuts groups before and after the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def lexical(q_terms: DataFrame, d_terms: DataFrame, qid: str, did: str, depth: int) -> DataFrame:
    """Share of a question's inverse-frequency weight that a passage holds; the best `depth` passages.

    Frequencies are counted over passages that share a term with any question;
    only those terms are stored, and read for counts and scores. Passages are
    dealt out so that a task scores about PAIRS pairs whatever the input.
    Terms of no passage weigh 1.
    """
    wanted = q_terms.select("term").distinct()
    small = F.broadcast if _few(q_terms) else lambda df: df
    hits = write_once(d_terms.join(small(wanted), "term", "left_semi"), "hits")
    n = hits.agg(F.count_distinct(did).alias("n"))
    idf = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", F.ln((F.col("n") + 1.0) / (F.col("df") + 0.5)).alias("idf"))
    weighted = q_terms.join(idf, "term", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    totals = weighted.groupBy(qid).agg(F.sum("idf").alias("total"))
    scored = hits.repartition(pair_parts(hits, q_terms), did).join(small(weighted.join(totals, qid)), "term").groupBy(qid, did).agg((F.sum("idf") / F.first("total")).alias("raw"))
    scored = scored.select(qid, did, F.round("raw", 9).alias("score")).where("score > 0")
    return top(scored, [qid], [F.desc("score"), F.col(did)], depth)


#: Pairs of a question's and a passage's common term that one task sums.
PAIRS = 1 << 20


def pair_parts(hits: DataFrame, q_terms: DataFrame) -> int:
    """How many parts hits (stored) need so that one holds about PAIRS pairs with the questions' terms."""
    asked = q_terms.groupBy("term").agg(F.count(F.lit(1)).alias("_q"))
    pairs = hits.groupBy("term").agg(F.count(F.lit(1)).alias("_d")).join(asked, "term").agg(F.sum(F.col("_q") * F.col("_d"))).first()[0] or 0
    return max(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))


def _few(df: DataFrame) -> bool:
    return df.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS


def bm25_index(docs: DataFrame, did: str, tokens: Column, max_ratio: float = 0.10, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (id, term, tf, doc_len, idf) without terms of too many documents, and the corpus statistics.

    wanted (term): only postings of these terms are made; lengths and statistics are those of the whole documents.
    """
    rows = write_once(docs.select(did, tokens.alias("_t")), "tokens").withColumn("doc_len", F.size("_t").cast("long"))  # read for statistics and postings
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avgdl"))
    exploded = rows.select(did, "doc_len", F.explode("_t").alias("term"))
    if wanted is not None:
        exploded = exploded.join(F.broadcast(wanted) if _few(wanted) else wanted, "term", "left_semi")
    postings = exploded.repartition(did).groupBy(did, "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))  # one exchange, read by df and scores
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats))
    kept = df.where(F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(max_ratio)))).select("term", "df", "avgdl", F.ln(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return postings.join(kept, "term"), stats


def bm25(postings: DataFrame, q_terms: DataFrame, qid: str, did: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Okapi scores of the documents that share a term with each question, to 9 places."""
    norm = F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.greatest(F.col("doc_len"), F.lit(1)) / F.col("avgdl"))
    part = F.col("idf") * F.col("tf") * F.lit(k1 + 1) / norm
    return postings.join(F.broadcast(q_terms) if _few(q_terms) else q_terms, "term").groupBy(qid, did).agg(F.round(F.sum(part), 9).alias("score"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in array order, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def knn_pairs(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Every (query_id, id) with its exact score as a row; the specification, for small query sets (query_id, query; id, embedding)."""
    return corpus.crossJoin(F.broadcast(queries)).withColumn("score", dot(F.col("query"), F.col("embedding"))).drop("query", "embedding")


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the query side, `block` at a time; one empty block if there are none."""
    rows = ((r[0], r[1]) for r in queries.select("query_id", "query").toLocalIterator())
    part = list(islice(rows, block))
    while True:
        yield np.array([i for i, _ in part]), np.array([v for _, v in part], np.float64)
        if not (part := list(islice(rows, block))):
            return


def knn(queries: DataFrame, corpus: DataFrame, k: int, group: str | None = None, block: int = 2048, digits: int | None = None) -> DataFrame:
    """Exact top-k of each query, within each group of the corpus if one is named.

    queries (query_id, query) may have any number of rows; it is read a partition
    at a time and broadcast in blocks of at most `block` vectors, each scanning
    the corpus once. A task scores TILE rows at a time and keeps the best k of
    each query and group only, so neither its memory nor what is shuffled
    follows the corpus. With digits, scores are rounded before they are ranked.
    """
    groups = [group] if group else []
    context = queries.sparkSession.sparkContext
    parts = []
    for sent in map(context.broadcast, _blocks(queries, block)):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            heads: dict = {}
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                vectors = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
                own = batch.column(0).to_numpy(zero_copy_only=False)
                coded = batch.column(2).dictionary_encode("encode") if group else None
                for g, label in enumerate(coded.dictionary.to_pylist() if group else [None]):
                    mine = np.flatnonzero(coded.indices.to_numpy() == g) if group else np.arange(batch.num_rows)
                    for at in range(0, len(mine), TILE):
                        heads[label] = _better(heads.get(label), matrix, vectors[mine[at : at + TILE]], own[mine[at : at + TILE]], k, digits)
            for label, (q, i, score) in heads.items():
                columns = [pa.array(ids[q]), pa.array(i), pa.array(score)]
                if group:
                    columns.append(pa.array([label] * len(q), batch.schema.field(2).type))
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score", *groups])

        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, score double"
        if group:
            schema += f", {group} {corpus.schema[group].dataType.simpleString()}"
        parts.append(corpus.where("embedding is not null").select("id", "embedding", *groups).mapInArrow(run, schema))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.union(part)
    return top(merged, ["query_id", *groups], [F.desc("score"), F.col("id")], k)


#: Rows of the corpus that are scored together: with 2,048 queries 8 MB of scores.
TILE = 512


def _rounded(score: np.ndarray, digits: int) -> np.ndarray:
    """Rounded to places, halves away from zero, as SQL does; what overflows stays."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = score * 10.0**digits
        whole = np.trunc(scaled)
        out = (whole + np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0.0)) / 10.0**digits
    return np.where(np.isfinite(out), out, score)


def _better(head: tuple | None, matrix: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query (its place, id, score; by place, falling score, id) among a head and more vectors.

    A matrix product says which pairs can be among them: it and the sum in array order are each within dims x epsilon x
    both norms of the true score. Those pairs are summed again in array order, as the specification does, so that equal
    scores stay equal. With digits, scores are equal that round to one value, so pairs a unit of the last place below
    are summed too, and of those that cannot round to more than the last of a full head only smaller ids.
    """
    unit = 0.0 if digits is None else 10.0**-digits
    near = matrix @ vectors.T
    norms = np.sqrt((matrix * matrix).sum(axis=1)), np.sqrt((vectors * vectors).sum(axis=1)).max(initial=0.0)
    slack = 4 * matrix.shape[1] * np.finfo(np.float64).eps * norms[0] * norms[1]
    least = np.full(len(matrix), -np.inf)
    if head is not None:
        q, _, score = head
        ends = np.searchsorted(q, np.arange(len(matrix)), "right") - 1
        full = np.bincount(q, minlength=len(matrix)) == k
        least[full] = score[ends[full]]
    elif len(own) > k:
        least = np.partition(near, -k, axis=1)[:, -k] - slack
    q, i = np.nonzero(~(near < np.nan_to_num(least - slack - unit, nan=np.inf, posinf=np.inf, neginf=-np.inf)[:, None]))  # what is not a number stays
    if head is not None and digits is not None:
        late = full[q] & (near[q, i] < (least + 0.499 * unit - slack)[q]) & (own[i] > head[1][ends[q]])
        q, i = q[~late], i[~late]
    score = np.zeros(len(q))
    for d in range(matrix.shape[1]):
        score += matrix[q, d] * vectors[i, d]
    if digits is not None:
        score = _rounded(score, digits)
    ids = own[i]
    if head is not None:
        q, ids, score = (np.concatenate(pair) for pair in zip(head, (q, ids, score), strict=True))
    order = np.lexsort((ids, np.where(np.isnan(score), -np.inf, -score), q))
    q = q[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], ids[order][kept], score[order][kept]


#: Pairs of a query and a vector that one task scores in all_pairs.
SCORED = 1 << 31


def all_pairs(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The k best of every query's pairs with the whole corpus, by score to `digits` places, then id.

    The pairs are scored in blocks (`knn`) and never become rows. As in SQL, a missing element counts nothing, and a
    vector without elements has no score with any other: such pairs come last, by id, so k of them are enough.
    """
    spark, some = corpus.sparkSession, lambda c: F.coalesce(F.exists(c, lambda x: x.isNotNull()), F.lit(False))
    sides = queries.select(F.lit(True).alias("asked"), F.col("query").alias("v")).unionByName(corpus.select(F.lit(False).alias("asked"), F.col("embedding").alias("v")))
    n = sides.agg(F.count_if("asked").alias("asked"), F.count_if(~F.col("asked")).alias("rows"), F.max(F.size("v")).alias("dims"), F.count_if(~some(F.col("v"))).alias("bare")).first()
    dims = max(n["dims"] or 0, 1)

    def even(df: DataFrame, c: str) -> Column:
        """The vector with 0 for every missing element."""
        v, zero = F.col(c), F.lit(0).cast(df.schema[c].dataType.elementType)
        padded = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.get(v, i), zero))
        return F.when((F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull()), v).otherwise(padded).alias(c)

    parts = max(spark.sparkContext.defaultParallelism, -(-n["asked"] * n["rows"] // SCORED))
    full = corpus.where(some(F.col("embedding"))).select("id", even(corpus, "embedding")).repartition(parts)
    pairs = knn(queries.where(some(F.col("query"))).select("query_id", even(queries, "query")), full, k, digits=digits).drop("rank")
    if n["bare"]:
        first = lambda ids: F.broadcast(ids.select("id").orderBy("id").limit(k))
        bare = [queries.where(~some(F.col("query"))).select("query_id").crossJoin(first(corpus)), queries.where(some(F.col("query"))).select("query_id").crossJoin(first(corpus.where(~some(F.col("embedding")))))]
        for b in bare:
            pairs = pairs.unionByName(b.withColumn("score", F.lit(None).cast("double")))
    return top(pairs, ["query_id"], [F.desc("score"), F.col("id")], k)


def merge_shards(heads: list[DataFrame], by: list[str], k: int) -> DataFrame:
    """W02, score: the k best of each query over the shards' own heads (id, score), in whatever order they come.

    Two shards' heads merge to the head of both, so heads of heads merge in the same way; the cut before the shuffle
    keeps at most k rows of a query from each task.
    """
    rows = heads[0].select(*by, "id", "score")
    for head in heads[1:]:
        rows = rows.unionByName(head.select(*by, "id", "score"))
    return top(rows, by, [F.desc("score"), F.col("id")], k)


def rerank(pool: DataFrame, by: str, score: str, place: str, depth: int | None = None) -> DataFrame:
    """1-based ranks by score, ties in pool order, cut at a depth."""
    ranked = pool.withColumn("rerank_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), place)))
    return ranked.where(F.col("rerank_rank") <= depth) if depth else ranked


def context(kept: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """`[i] text` lines of each question's kept candidates; bounded by the depth of a candidate list."""
    ranked = kept.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    line = F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("] "), F.col(text))
    lines = F.array_sort(F.collect_list(F.struct(F.col("_i"), line.alias("l"))))
    return ranked.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("context"), F.count(F.lit(1)).alias("n_passages"))
