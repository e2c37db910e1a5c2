"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are folded to lower case, everything but letters becomes a space, and
all 1- to 3-grams of characters are hashed into BUCKETS. Counts per language
are summed on the executors from a documented sample of at most about
``rows_per_lang`` labelled rows of each language (whole texts; every row is
drawn on its own, copies of a text too, so no language can drop out with one
text). The first ``max_langs`` languages by rows are learnt, so the
log-probability matrix (languages x BUCKETS) has at most max_langs x 256 KB,
however many values the column has; it is broadcast, and each batch is scored at
once in numpy. Every text is scored whole.

Defined cases: a null text, or one without a letter, is `und` with score 0;
rows without a language, or with a null id, teach nothing; ties go to the
first language in string order; without any labelled row all are `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import bound_batches, private

BUCKETS = 1 << 16
ROWS_PER_LANG, MAX_LANGS = 8000, 256
SMOOTHING = 0.5
BLOCK_CHARS = 1 << 18
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of each n-gram, and which texts have a letter."""
    raw = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    size = np.array([len(r) // 4 for r in raw])
    points = np.frombuffer(b"".join(raw), np.uint32)
    owner = np.repeat(np.arange(len(texts)), size)
    letter = _letter_table()[points]
    lettered = np.bincount(owner[letter], minlength=len(texts)) > 0
    c = np.where(letter, points, 32).astype(np.uint32)
    parts, owners = [], []
    with np.errstate(over="ignore"):
        for n, factors in ((1, (2654435761,)), (2, (2246822519, 3266489917)), (3, (668265263, 374761393, 2869860233))):
            m = len(c) - n + 1
            if m <= 0:
                continue
            h = np.full(m, 97 * n, np.uint32)
            useful = np.zeros(m, bool)
            for i, f in enumerate(factors):
                h += (c[i : m + i] + np.uint32(1)) * np.uint32(f)
                useful |= letter[i : m + i]
            useful &= owner[:m] == owner[n - 1 :]
            h ^= h >> np.uint32(15)
            h *= np.uint32(2246822519)
            parts.append((h >> np.uint32(16))[useful])
            owners.append(owner[:m][useful])
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), lettered
    return np.concatenate(parts), np.concatenate(owners), lettered


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x langs, float32
    prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names: list[str] = []
        scores = np.zeros(len(texts))
        done = 0
        for block in _blocks([t or "" for t in texts]):
            bucket, owner, lettered = _grams(block)
            logp = np.empty((len(block), len(self.langs)))
            for k in range(len(self.langs)):
                logp[:, k] = np.bincount(owner, weights=self.table[bucket, k], minlength=len(block)) + self.prior[k]
            for i in range(len(block)):
                if not lettered[i] or not self.langs:
                    names.append("und")
                    continue
                best = int(np.argmax(logp[i]))
                names.append(self.langs[best])
                scores[done + i] = 1.0 / np.exp(logp[i] - logp[i, best]).sum()
            done += len(block)
        return names, scores


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(t or "")
        for lang, texts in by_lang.items():
            rows[lang] = rows.get(lang, 0) + len(texts)
            mine = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for block in _blocks(texts):
                mine += np.bincount(_grams(block)[0], minlength=BUCKETS)
    for lang, mine in counts.items():
        used = np.flatnonzero(mine)
        bucket = np.concatenate([[-1], used])  # -1: the rows seen
        n = np.concatenate([[rows[lang]], mine[used]])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket)), pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "bucket", "n"])


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", rows_per_lang: int = ROWS_PER_LANG, max_langs: int = MAX_LANGS) -> Model:
    """Learn from a drawn sample of about rows_per_lang rows of each language, or all rows if there are fewer."""
    bound_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs)
    sizes = {r["lang"]: r["count"] for r in most.collect()}
    chances = labelled.sparkSession.createDataFrame([(name, int(min(1.0, rows_per_lang / n) * (1 << 30))) for name, n in sizes.items()], "lang string, chance long")
    drawn = rows.withColumn("u", F.pmod(F.xxhash64("text", "lang", F.monotonically_increasing_id()), F.lit(1 << 30)))
    drawn = drawn.join(F.broadcast(chances), "lang").where(F.col("u") < F.col("chance")).select("lang", "text")
    counts = drawn.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    at = {name: k for k, name in enumerate(langs)}
    column = np.array([at[x] for x in counts.column("lang").to_pylist()], np.int64)
    bucket, n = counts.column("bucket").to_numpy().astype(np.int64), counts.column("n").to_numpy()
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    gram = bucket >= 0
    np.add.at(table, (bucket[gram], column[gram]), n[gram])
    prior = np.array([sizes[name] for name in langs], dtype=float)
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()) if langs else prior)


def detect(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every row (default: all), lang_pred and score; clashing names are replaced."""
    bound_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    p = private(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "".join(f"`{p}{i}` {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.score(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores)], names=[*(f"{p}{i}" for i in range(len(keep))), "lang_pred", "score"])

    source = docs.select(F.col(text).cast("string").alias(f"{p}text"), *[F.col(c).alias(f"{p}{i}") for i, c in enumerate(keep)])
    out = source.mapInArrow(run, f"{fields}lang_pred string, score double")
    return out.select(*[F.col(f"{p}{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null without an id."""
    return F.crc32(doc_id.cast("string")) % folds
