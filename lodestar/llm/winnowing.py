"""Benchmark decontamination by winnowing.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after folding A-Z. Of every
WINDOW consecutive K-grams the one with the smallest hash is kept, in training
and test texts alike, so any shared span of WINDOW + K - 1 = 13 words shares a
kept fingerprint. Training and test fingerprints are joined, each different one
of a text once, and the hits are extended over their texts: every window of 13
words of a text with a hit is looked up among the items' windows, where each
different one stands once, however often a text or an item repeats it. Items of
fewer than 13 words lie under that guarantee: they are looked up as one whole
gram of their own length.

The benchmark is the stated query set. Its size is measured first; it is
broadcast in blocks of at most BLOCK_BYTES of text, each block against all
documents, so a benchmark of any size works and the documents are never
shuffled.

Defined cases: null or wordless documents have no words and no hits; null and
wordless items have no windows; items with one id count once, and a null id
counts as the empty string; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrow as A
from ._store import bound_batches, private, store

SPAN, K = 13, 5
WINDOW = SPAN - K + 1
BLOCK_BYTES = 32 << 20
_WORD, _GRAM = A.byte_values(21, lower=True), 23


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the index of each document's first one."""
    starts, ends = A.bounds(~A.NOT_ALNUM[data], offsets)
    return A.span_hashes(_WORD[data], starts, ends), A.per_document(starts, offsets)


def winnow(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept K-grams: hash and position of the (rightmost) smallest one in each window of a document."""
    grams, at = A.windows(words, first, K, 22)
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, A.U64), np.zeros(0, np.int64)
    low, where = grams[:n].copy(), np.arange(n)
    for i in range(1, WINDOW):
        nearer = grams[i : n + i] <= low
        low[nearer] = grams[i : n + i][nearer]
        where[nearer] = np.flatnonzero(nearer) + i
    same = at[WINDOW - 1 :] - at[:n] == WINDOW - 1  # the window lies in one document
    kept = np.unique(where[same])
    return grams[kept], at[kept]


class Index:
    """Fingerprints and words of a block of test items."""

    def __init__(self, ids: list[str], data: np.ndarray, offsets: np.ndarray):
        self.ids = ids
        self.words, self.first = words_of(data, offsets)
        length = np.diff(self.first)
        self.item = np.repeat(np.arange(len(length)), length)  # of each word
        self.prints = np.unique(winnow(self.words, self.first)[0])
        grams, at = A.windows(self.words, self.first, SPAN, _GRAM)
        self.grams, self.of_gram = _different(grams, self.item[at])
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted(set(length[(length > 0) & (length < SPAN)].tolist())):
            grams, at = A.windows(self.words, self.first, n, 30 + n)
            whole = length[self.item[at]] == n
            grams, at = grams[whole], at[whole]
            self.short[n] = _different(grams, self.item[at])


def _pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal values; right is sorted."""
    a, b = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
    n = b - a
    i = np.repeat(np.arange(len(left)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)


def _different(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of gram and owner once, in order of grams."""
    order = np.lexsort((owner, grams))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], owner[new]


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def occurrences(index: Index, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the windows of the texts that are windows of items; then text and item of each pair that shares one."""
    none = np.zeros(0, np.int64)
    starts, ends, texts, items = [none], [none], [none], [none]

    def look_up(own: np.ndarray, own_first: np.ndarray, shift: np.ndarray, width: int, salt: int, grams: np.ndarray, of_gram: np.ndarray) -> None:
        mine, at = A.windows(own, own_first, width, salt)
        found = _among(mine, grams)
        mine, at = mine[found], at[found]
        text = np.searchsorted(own_first, at, side="right") - 1
        starts.append(at + shift[text])
        ends.append(at + shift[text] + width)
        mine, text = _different(mine, text)
        i, j = _pairs(mine, grams)
        texts.append(text[i])
        items.append(of_gram[j])

    prints, at = winnow(words, first)
    hit = np.unique(np.searchsorted(first, at[_among(prints, index.prints)], side="right") - 1)
    if len(hit):
        length = first[hit + 1] - first[hit]
        own_first = np.concatenate([[0], np.cumsum(length)])
        shift = first[hit] - own_first[:-1]
        before = len(texts)
        look_up(words[np.arange(own_first[-1]) + np.repeat(shift, length)], own_first, shift, SPAN, _GRAM, index.grams, index.of_gram)
        texts[before] = hit[texts[before]]
    for n, (grams, of_gram) in index.short.items():
        look_up(words, first, np.zeros(len(first), np.int64), n, 30 + n, grams, of_gram)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(texts), np.concatenate(items)


def _kernel(index, keep: list[str], merge: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for batch in batches:
            data, offsets = A.buffers(batch.column(0))
            n_words, n_hit, starts, ends, per_doc, named = [], [], [], [], [], []
            for i, j in A.blocks(offsets):
                at = offsets[i : j + 1]
                words, first = words_of(data[at[0] : at[-1]], at - at[0])
                start, end, doc, item = occurrences(own, words, first)
                items: list[set[str]] = [set() for _ in range(j - i)]
                for d, x in set(zip(doc.tolist(), item.tolist(), strict=True)):
                    items[d].add(own.ids[x])
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, end, -1)
                hit = np.cumsum(depth)[:-1] > 0
                if merge:
                    for d, (spans, more) in enumerate(zip(batch.column(1).slice(i, j - i).to_pylist(), batch.column(2).slice(i, j - i).to_pylist(), strict=True)):
                        items[d] |= set(more)
                        for s in spans:
                            hit[first[d] + s["start"] : first[d] + s["end"]] = True
                a, b = A.bounds(hit, first)
                per = A.per_document(a, first)
                mine = np.repeat(first[:-1], np.diff(per))
                total = np.concatenate([[0], np.cumsum(hit)])
                for held, x in ((n_words, np.diff(first)), (n_hit, np.diff(total[first])), (starts, a - mine), (ends, b - mine), (per_doc, np.diff(per))):
                    held.append(x.astype(np.int64))
                named += [sorted(x) for x in items]
            # one batch out for each batch in: carried columns pass as they are
            joined = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
            spans = pa.StructArray.from_arrays([pa.array(joined(starts)), pa.array(joined(ends))], ["start", "end"])
            carried = batch.columns[3 if merge else 1 :]
            columns = [*carried, pa.array(joined(n_words)), pa.array(joined(n_hit)), A.lists(spans, np.concatenate([[0], np.cumsum(joined(per_doc))])), pa.array(named, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "n_hit", "hits", "items"])

    return run


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For every row of docs: the kept columns, n_words, n_hit, hits (runs of word positions) and items (sorted ids).

    keep: columns of docs to carry (default: all); of these, ones named like an added column are left out.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    added = ["n_words", "n_hit", "hits", "items"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("id")), F.lit(0))).first()[0]
    count = max(1, -(-int(size) // BLOCK_BYTES))
    p = private(docs, *added)
    out = docs.select(F.col(text).cast("string").alias(f"{p}text"), *[F.col(c).alias(f"{p}{i}") for i, c in enumerate(keep)])
    names = [f"{p}{i}" for i in range(len(keep))]
    for b in range(count):
        block = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(count)) == b).toArrow() if count > 1 else items.toArrow()
        index = spark.sparkContext.broadcast(Index(block.column("id").to_pylist(), *A.buffers(block.column("t"))))
        carried = names if b == count - 1 else [f"{p}text", *names]
        fields = "".join(f"`{c}` {out.schema[c].dataType.simpleString()}, " for c in carried)
        source = out.withColumn(f"{p}copy", F.col(f"{p}text")).select(f"{p}copy", *(["hits", "items"] if b else []), *carried)
        out = source.mapInArrow(_kernel(index, carried, b > 0), f"{fields}n_words long, n_hit long, hits array<struct<start:long,end:long>>, items array<string>")
        if b < count - 1:  # one block's index in memory at a time
            out = store(out, "overlaps").df
    return out.select(*[F.col(f"{p}{i}").alias(c) for i, c in enumerate(keep)], *added)


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, without the contaminated ones."""
    p = private(docs, "n_words", "n_hit", "hits", "items")
    named = docs.select(*[F.col(c).alias(f"{p}c{i}") for i, c in enumerate(docs.columns)])
    at = [c.lower() for c in docs.columns].index(text.lower())
    found = find_overlaps(named, benchmark, text=f"{p}c{at}", item_id=item_id, item_text=item_text)
    clean = found.where(~contaminated(F.col("n_hit"), F.col("n_words")))
    return clean.select(*[F.col(f"{p}c{i}").alias(c) for i, c in enumerate(docs.columns)])
