"""Delta-maintained rollups of token counts by source, language and tokenizer version.

The store keeps one small table of signed deltas for each committed batch:
inserts count +1 document and its tokens, deletes -1 and minus its tokens, and
a revision is a delete of the old count with an insert of the new one. Totals
are the sums over all committed batches, so batches may arrive in any order,
and nothing that is already summed is read again.

A batch is committed by its id. Each writer writes the deltas whole under the
batch's folder in a folder of its own; it counts once its success mark is there,
and of several writers of one batch readers take one, the first by name, so a
replay, also one after a lost driver, a half-done write or beside another
writer, changes nothing. No rename is needed, so any store will do.

compact() sums what is committed into a rolled-up table that names its batches;
totals then read the newest one and the batches after it.

Defined cases: a null text has no tokens; null sources and languages are
groups of their own; repeated rows count each; groups whose documents and
tokens are all gone are left out of the totals; an empty batch is committed
without deltas.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import _hadoop, new_path

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"
#: Token counts of two versions of a plain tokenizer: words, then words with punctuation marks apart.
WORDS_V1, WORDS_V2 = "words-v1", "words-v2"
PATTERNS = {WORDS_V1: r"[^\x20\x09-\x0D]+", WORDS_V2: r"[.,;:!?]|[^\x20\x09-\x0D.,;:!?]+"}


def token_count(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[tokenizer])).cast("long"), F.lit(0).cast("long"))


def signed_counts(docs: DataFrame, tokenizer: str, sign: int, *, text: str = "text") -> DataFrame:
    """One signed row for each document."""
    n = token_count(F.col(text).cast("string"), tokenizer)
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("documents"), (F.lit(sign) * n).cast("long").alias("tokens"))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class RollupStore:
    """Committed batches of deltas under one folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "token-rollup")

    def _at(self, batch_id: str) -> str:
        if not batch_id or not all(c.isalnum() or c in "-_." for c in batch_id) or batch_id.startswith((".", "_")):
            raise ValueError(f"bad batch id {batch_id!r}")
        return f"{self.path}/batches/{batch_id}"

    def _names(self, folder: str) -> list[str]:
        fs, at = _hadoop(self.spark, folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _whole(self, folder: str) -> list[str]:
        """The tables under a folder that were written to their end."""
        return [n for n in self._names(folder) if "_SUCCESS" in self._names(f"{folder}/{n}")]

    def committed(self, batch_id: str) -> bool:
        return bool(self._whole(self._at(batch_id)))

    def batches(self) -> list[str]:
        return [b for b in self._names(f"{self.path}/batches") if self.committed(b)]

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Sum the signed rows and commit them; False if the batch is there already."""
        if self.committed(batch_id):
            return False
        own = uuid.uuid4().hex
        _sums(deltas).where("documents <> 0 or tokens <> 0").write.parquet(f"{self._at(batch_id)}/{own}")
        return self._whole(self._at(batch_id))[0] == own

    def _rolled(self) -> tuple[str | None, set[str]]:
        """The newest rolled-up table and the batches in it."""
        done = self._whole(f"{self.path}/rolled")
        if not done:
            return None, set()
        inside = self.spark.read.schema("batch string").json(f"{self.path}/rolled-batches/{done[-1]}").collect()  # one row per batch
        return f"{self.path}/rolled/{done[-1]}", {r["batch"] for r in inside}

    def compact(self) -> None:
        """Roll all committed batches up into one table; the batches stay until they are deleted by hand."""
        names = self.batches()
        if not names:
            return
        name = f"{len(self._names(f'{self.path}/rolled')):08d}-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(b,) for b in names], "batch string").coalesce(1).write.json(f"{self.path}/rolled-batches/{name}")
        self._read(names).write.parquet(f"{self.path}/rolled/{name}")

    def _read(self, names: list[str]) -> DataFrame:
        rolled, inside = self._rolled()
        paths = [f"{self._at(b)}/{self._whole(self._at(b))[0]}" for b in names if b not in inside] + ([rolled] if rolled else [])
        return _sums(self.spark.read.schema(SCHEMA).parquet(*paths))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents and tokens over all committed batches."""
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self._read(names).where("documents <> 0 or tokens <> 0")


def maintain(docs: DataFrame, *, text: str = "text") -> RollupStore:
    """The life of a corpus in four batches, one of them replayed.

    All documents arrive with words-v1; English ones are then recounted with
    words-v2 (a delete and an insert each), and documents without a word are
    deleted, each under the version that last counted it.
    """
    rollup = RollupStore(docs.sparkSession)
    rollup.commit("inserts", signed_counts(docs, WORDS_V1, 1, text=text))
    english = docs.where(F.col("lang") == "en")
    revised = signed_counts(english, WORDS_V1, -1, text=text).union(signed_counts(english, WORDS_V2, 1, text=text))
    rollup.commit("revise-english", revised)
    rollup.commit("revise-english", revised)  # a replay
    empty = docs.where(token_count(F.col(text).cast("string"), WORDS_V1) == 0)
    is_english = F.coalesce(F.col("lang") == "en", F.lit(False))
    rollup.compact()
    rollup.commit("delete-empty", signed_counts(empty.where(~is_english), WORDS_V1, -1, text=text).union(signed_counts(empty.where(is_english), WORDS_V2, -1, text=text)))
    return rollup
