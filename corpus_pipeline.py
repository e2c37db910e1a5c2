"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor
kept, and returns the rows it keeps with the columns of documents; the last one
returns the packed pieces. run() writes each stage's rows as Parquet in the
folder that the cluster shares and reads them as the next one's docs.

Defined cases: null and letterless texts are rejected by the first stage; an
empty table runs through; of rows with one id and text one stays, and a repeated
id loses only texts that are copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import langid, minhash, packing, pii, winnowing
from lodestar.llm._store import store

#: Words that a packing worker keeps; workers live through all stages here, so fewer than in a job of its own.
CACHE_WORDS = 80_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found; those without a text or a letter go."""
    model = langid.fit(docs.where(langid.fold(F.col("doc_id"), 4) != 2))
    return langid.detect(docs, model).where(F.col("lang_pred") != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id."""
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which less than a twentieth of the words repeat a benchmark window."""
    return winnowing.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its personal data replaced by the kind in brackets and n_chars counted anew."""
    out = pii.detect(docs.select(*[c for c in docs.columns if c != "n_chars"]))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    packed = packing.pack_documents(docs, cache_words=CACHE_WORDS)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]
#: Near-duplicates, learnt models and tokenizers are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return docs
