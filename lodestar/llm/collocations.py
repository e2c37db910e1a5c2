"""Phrase collocation mining over all 1..max_n-grams of every language.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and the
pieces into words ``[^\\x20\\x09]+``. The n-grams of each length become rows
(lang, phrase, f), counted within a block of texts where they are made and then
by a hash aggregation on language and phrase, so neither a hot language nor a
hot phrase gathers rows in one task. Lengths are taken one after the other: an
n-gram can only occur ``min_count`` times if both of its (n-1)-grams do, so
n-grams with a rarer one become no rows. That test asks a table of FILTER_BITS
bits (its size doesn't follow the input), where every frequent (n-1)-gram has
its bit; a foreign phrase with the same bit costs a row and changes no count.
With more frequent phrases than bits the table lets all pass, and the rows are
those of all n-grams.

Candidates (2..max_n words, f >= min_count) are cut after each word and joined
with the counts of both parts, scored as floor(10^6 a a / (l r)) in 38-digit
decimals, and keep their lowest score. A candidate is dropped by the anti-join
with its one-word extensions that hold at least ``extension_percent`` of its
occurrences; longer extensions lie inside such a one. Ranks come from windows
in two steps, over PARTS parts of a language and then over the first ``top`` of
each part, so the last step sees at most PARTS x top rows of a language.

Defined cases: a null text is empty, a null language is ``und`` and one with
the rows named so; each row counts, repeated rows included; ties go by
phrase in UTF-8 byte order; an empty table, or one without candidates, gives no
rows. A text is read in blocks that end between pieces, so a long text needs no
more memory than its longest piece or BLOCK bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _arrow as A
from ._store import bound_batches, store

MAX_N, MIN_COUNT, EXTENSION_PERCENT, TOP = 3, 10, 50, 2000
FILTER_BITS, PARTS = 1 << 26, 64
#: Bytes read at once, and bytes of words whose n-grams are counted together.
BLOCK, HELD = 1 << 20, 6 << 20
#: Phrases in a batch that goes to Spark.
ROWS = 1 << 15

_BREAK = A.byte_set((0x0A, 0x0D))
_BREAK[np.frombuffer(b".,;:!?", np.uint8)] = True
_INSIDE = ~(_BREAK | A.byte_set((0x20, 0x20), (0x09, 0x09)))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD, _LANG = A.byte_values(131), A.byte_values(132)
_NEXT = A.U64(0x9E3779B97F4A7C15)


def _lang_hash(lang: str) -> np.ndarray:
    raw = np.frombuffer(lang.encode(), np.uint8)
    return A.span_hashes(_LANG[raw], np.array([0]), np.array([len(raw)]))[0]


def _follow(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return A.mix(grams * _NEXT + words)


def _slot(grams: np.ndarray, size: int) -> np.ndarray:
    return (grams >> A.U64(16)) % A.U64(size)


class _Words:
    """Words of many texts: folded bytes with one space after each word, a hash of language and word, and whether the next word follows in the same piece."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, codes: np.ndarray, hashes: np.ndarray) -> None:
        inside = _INSIDE[data]
        starts, ends = A.bounds(inside, offsets)
        if not len(starts):
            return
        folded = _FOLD[data]
        doc = np.searchsorted(offsets, starts, side="right") - 1
        broken = np.cumsum(_BREAK[data])[starts]
        goes_on = np.zeros(len(starts), bool)
        goes_on[:-1] = (broken[1:] == broken[:-1]) & (doc[1:] == doc[:-1])
        size = (ends - starts).astype(np.int32)
        plain = np.full(int(size.sum()) + len(starts), 32, np.uint8)
        plain[np.arange(int(size.sum())) + np.repeat(np.arange(len(starts)), size)] = folded[inside]
        lang = codes[doc].astype(np.int32)
        self.parts.append((plain, size, A.mix(A.span_hashes(_WORD[folded], starts, ends) ^ hashes[lang]), goes_on, lang))
        self.bytes += len(plain)

    def grams(self, n: int, bits: np.ndarray | None, langs: list[str]) -> Iterator[pa.RecordBatch]:
        """The n-grams of all words held, counted, in batches of ROWS; bits tell the frequent (n-1)-grams."""
        plain, size, words, goes_on, lang = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.__init__()
        at = np.cumsum(size + 1, dtype=np.int64) - size - 1
        if n == 1:
            first = np.arange(len(words))
        else:
            shorter, whole = words, np.ones(len(words), bool)
            for k in range(1, n - 1):  # hashes of (n-1)-grams, and whether each lies in one piece
                shorter = _follow(shorter[:-1], words[k:])
                whole = whole[:-1] & goes_on[k - 1 : len(goes_on) - 1]
            slot = _slot(shorter, 8 * len(bits))
            usual = whole & ((bits[slot >> A.U64(3)] >> (slot & A.U64(7)).astype(np.uint8)) & 1).astype(bool)
            first = np.flatnonzero(usual[:-1] & usual[1:] & goes_on[: len(usual) - 1])
        _, ids = np.unique(words, return_inverse=True)
        name = ids[first]
        for k in range(1, n):
            _, name = np.unique(name * (int(ids.max(initial=0)) + 1) + ids[first + k], return_inverse=True)
        _, where, f = np.unique(name, return_index=True, return_counts=True)
        names, begins = pa.array(langs, pa.string()), first[where]
        del ids, name, words
        for i in range(0, len(begins), ROWS):
            begin = begins[i : i + ROWS]
            start, length = at[begin], at[begin + n - 1] + size[begin + n - 1] - at[begin]
            offsets = np.concatenate([[0], np.cumsum(length)])
            chars = plain[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)]
            phrases = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(chars.tobytes())])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[begin])), phrases.cast(pa.string()), pa.array(f[i : i + ROWS].astype(np.int64))], names=["lang", "phrase", "f"])


def _cuts(data: np.ndarray, offsets: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with long texts cut between pieces, and the text of each part."""
    more = []
    for d in np.flatnonzero(np.diff(offsets) > block):
        at, end = int(offsets[d]), int(offsets[d + 1])
        while end - at > block:
            breaks = np.flatnonzero(_BREAK[data[at : at + block]])
            if not len(breaks):  # no piece ends in this block: the next break after it, if there is one
                later = (at + k + i for k in range(block, end - at, block) for i in np.flatnonzero(_BREAK[data[at + k : min(at + k + block, end)]])[:1])
                at = next(later, end - 1) + 1
            else:
                at += int(breaks[-1]) + 1
            if at < end:
                more.append(at)
    if not more:
        return offsets, np.arange(len(offsets) - 1)
    out = np.sort(np.concatenate([offsets, more]))
    return out, np.searchsorted(offsets, out[:-1], side="right") - 1


def _count(n: int, bits, block: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, codes, hashes = _Words(), {}, []
        for batch in batches:
            data, offsets = A.buffers(batch.column(1))
            mine = []
            for lang in batch.column(0).to_pylist():
                if lang not in codes:
                    codes[lang] = len(codes)
                    hashes.append(_lang_hash(lang))
                mine.append(codes[lang])
            parts, owner = _cuts(data, offsets, block)
            code = np.array(mine, np.int64)[owner]
            for i, j in A.blocks(parts, block):
                at = parts[i : j + 1]
                held.add(data[at[0] : at[-1]], at - at[0], code[i:j], np.array(hashes, A.U64))
                if held.bytes >= most:
                    yield from held.grams(n, bits and bits.value, list(codes))
        if held.parts:
            yield from held.grams(n, bits and bits.value, list(codes))

    return run


def _slots(size: int):
    """The slot of each phrase, hashed as in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.buffers(batch.column(1))
            starts, ends = A.bounds(data != 32, offsets)
            first = A.per_document(starts, offsets)
            langs = batch.column(0).to_pylist()
            known = {x: _lang_hash(x) for x in set(langs)}
            words = A.mix(A.span_hashes(_WORD[data], starts, ends) ^ np.repeat(np.array([known[x] for x in langs], A.U64), np.diff(first)))
            grams = words[first[:-1]].copy()
            for k in range(1, int(np.diff(first).max(initial=1))):
                longer = np.flatnonzero(np.diff(first) > k)
                grams[longer] = _follow(grams[longer], words[first[longer] + k])
            yield pa.RecordBatch.from_arrays([pa.array(A.signed(_slot(grams, size)))], names=["slot"])

    return run


def _filter(frequent: DataFrame, size: int):
    """A broadcast table of size bits (a multiple of 64) with those of the phrases set; it reaches the driver as one number for 64 bits."""
    slots = frequent.select("lang", "phrase").mapInArrow(_slots(size), "slot long")
    one = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    found = slots.groupBy(F.expr("slot div 64").alias("w")).agg(F.bit_or(one).alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def _words(column: str, a: Column | int, b: Column | int) -> Column:
    """Words a to b (from 1, inclusive) of a phrase."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (a, b))
    return F.array_join(F.slice(F.split(column, " "), a, b - a + 1), " ")


def gram_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_n: int = MAX_N, min_count: int = MIN_COUNT) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (lang, n); then for each length the phrases with at least min_count occurrences (lang, phrase, f)."""
    bound_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    totals, found, bits = None, [], None
    for n in range(1, max_n + 1):
        counted = source.mapInArrow(_count(n, bits, BLOCK, HELD), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        kept = store(counted if n == 1 else counted.where(F.col("f") >= min_count), f"grams-{n}").df
        if n == 1:
            totals = kept.groupBy("lang").agg(F.sum("f").alias("n"))
            kept = kept.where(F.col("f") >= min_count)
        found.append(kept)
        if n < max_n:
            bits = _filter(kept, FILTER_BITS)
    return totals, found


def collocations(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", max_n: int = MAX_N, min_count: int = MIN_COUNT, extension_percent: int = EXTENSION_PERCENT, top: int | None = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases (None: all, without a rank)."""
    if max_n < 2:
        raise ValueError("phrases have two words at least")
    totals, found = gram_counts(docs, text=text, lang=lang, max_n=max_n, min_count=min_count)
    sized = [df.withColumn("words", F.lit(n)) for n, df in enumerate(found, 1)]
    candidates, counts = functools.reduce(DataFrame.unionByName, sized[1:]), functools.reduce(DataFrame.unionByName, found[:-1])
    cut = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumns({"left": _words("phrase", 1, F.col("k")), "right": _words("phrase", F.col("k") + 1, F.col("words"))})
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumns({"_over": F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")).cast("decimal(31,0)"), "_under": (wide("l") * wide("r")).cast("decimal(38,0)")})
    scored = cut.select("lang", "phrase", "a", "words", F.struct(F.expr("_over div _under").alias("score"), "k", "l", "r").alias("cut"))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    longer = candidates.where("words > 2").select("lang", "f", F.explode(F.array(_words("phrase", 1, F.col("words") - 1), _words("phrase", 2, F.col("words")))).alias("phrase"))
    covering = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    covered = (F.col("longer").cast("decimal(38,0)") * 100) >= (F.col("a").cast("decimal(38,0)") * extension_percent)
    left = scored.join(covering, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    out = left.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    if top is None:
        return out
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = out.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
