"""Best-fit packing of tokenised documents into sequences of at most LENGTH tokens.

1. Documents become pieces: token ids, then the end id; longer ones are cut
   into full pieces and a rest.
2. A plan is made from the histogram of piece lengths alone, which has at most
   LENGTH entries however large the corpus is. Exact-complement hashing: from
   the longest length down, the gap is looked up among single lengths, then
   among sums of pairs, then of triples; a combination that fills the gap
   exactly is consumed as often as the availability counts allow. What is left
   goes best-fit decreasing, many equal bins at a time.
3. Every piece gets a rank among the pieces of its length and finds its place
   in the plan by that rank. Ranks are counted within salted groups of at
   most a GROUPS-th of all pieces, so a length that a third of all
   documents share is never ranked in one task.

Defined cases: a null text is empty and has the end id only; repeated rows are
packed each; null ids are carried; ties in rank fall between pieces of equal
length, where either order is right; an empty table gives no rows.
"""

from __future__ import annotations

import array
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from ._store import bound_batches, private, store

LENGTH, END_ID = 2048, 0
CACHE_WORDS = 300_000
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII signs but the apostrophe, which may begin a piece with the letters after it
GROUPS, LEAST_GROUP = 10_000, 500
LONG_TEXT = 1 << 20


class WordIds(dict):
    """Little-endian 32-bit ids of a word between spaces, as bytes; learnt on demand.

    The tokenizer cuts at white space and drops it, so a text's ids are its
    words' ids in a row. It also cuts between letters and signs, so a plain word
    with signs after it is both in a row. Plain letter words go straight to the
    merge model; any other word takes the whole way. Two generations of at most
    `most` words are held; a word of the older one that is met again moves on.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        self.most = most
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.bytes_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.older: dict[str, bytes] = {}
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = self._learn(word)
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
            self[""] = b""
        self[word] = out
        return out

    def _learn(self, word: str) -> bytes:
        if word.isalpha():
            if unicodedata.is_normalized("NFC", word):
                low = word.lower()
                if low == word:
                    mapped = word if word.isascii() else self.bytes_level.pre_tokenize_str(word)[0][0]
                    return _pack([t.id for t in self.model.tokenize(mapped)])
                if "Σ" not in word and unicodedata.is_normalized("NFC", low):
                    return self[low]
        else:
            stem = word.rstrip(SIGNS)
            if len(stem) < len(word) and stem.isalpha() and stem.lower()[-1].isalpha():  # no mark joins the stem to the signs
                return self[stem] + self[word[len(stem) :]]
        return _pack(self.whole.encode(word, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        get = self.__getitem__
        if len(text) <= LONG_TEXT:
            return b"".join(map(get, text.replace("\n", " ").split(" ")))
        out, at = bytearray(), 0  # a bounded part of a very long text at a time, cut at a space
        while at < len(text):
            cut = text.find(" ", at + LONG_TEXT)
            cut = len(text) if cut < 0 else cut
            out += b"".join(map(get, text[at:cut].replace("\n", " ").split(" ")))
            at = cut
        return bytes(out)


def _pack(ids) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_words: dict[tuple[str, int], WordIds] = {}


def _pieces(path: str, length: int, end_id: int, with_ids: bool, cache_words: int):
    end = _pack([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, cache_words)
        words = _words[key] if key in _words else _words.setdefault(key, WordIds(path, cache_words))
        for batch in batches:
            row, piece, start, size, crc, ids = [], [], [], [], [], []
            for i, t in enumerate(batch.column(0).to_pylist()):
                whole = words.ids(t or "") + end
                for k, at in enumerate(range(0, len(whole), 4 * length)):
                    part = whole[at : at + 4 * length]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            keys = batch.column(1).take(pa.array(row, pa.int64()))
            columns = [keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(crc, pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def cut_into_pieces(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: the id column, piece, start, length, ids_crc32 and, with with_ids, the ids. cache_words bounds what a worker keeps of words it has met."""
    bound_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    key = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(text).cast("string").alias("t"), F.col(doc_id).alias("key"))
    out = rows.mapInArrow(_pieces(path, length, end_id, with_ids, cache_words), f"key {key}, piece int, start long, length int, ids_crc32 long{', ids array<int>' if with_ids else ''}")
    return out.withColumnRenamed("key", doc_id)


class Plan:
    """Where the r-th piece of each length goes.

    Entries (length, first rank, past rank, first sequence, offset): the pieces
    of that length with ranks in the range take one sequence each, from the
    first sequence on, at that offset.
    """

    def __init__(self) -> None:
        self.entries: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self._used: dict[int, int] = {}

    def _take(self, length: int, n: int, sequence: int, offset: int) -> None:
        first = self._used.get(length, 0)
        self._used[length] = first + n
        self.entries.append((length, first, first + n, sequence, offset))

    def add(self, lengths: list[int], n: int) -> int:
        """n new sequences of these lengths; returns the first one."""
        first, self.sequences = self.sequences, self.sequences + n
        offset = 0
        for x in lengths:
            self._take(x, n, first, offset)
            offset += x
        return first


def _pair(counts: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Available lengths a >= b with a + b = total and a <= most; the longest a."""
    a = np.arange(min(most, total - 1), (total + 1) // 2 - 1, -1)
    if not len(a):
        return None
    ok = (counts[a] > 0) & (counts[total - a] > np.where(2 * a == total, 1, 0))
    k = int(np.argmax(ok))
    return (int(a[k]), total - int(a[k])) if ok[k] else None


def _complement(counts: np.ndarray, sums: np.ndarray, gap: int, most: int) -> list[int] | None:
    """Up to three available lengths that fill the gap exactly.

    sums: for each total, how many pairs of available lengths make it. A pair
    of one length with itself counts from one piece on, so a hit is checked
    against the counts.
    """
    if gap <= most and counts[gap] > 0:
        return [gap]
    if sums[gap] and (found := _pair(counts, gap, most)):
        return list(found)
    a = np.flatnonzero(counts[: min(most, gap - 2) + 1] > 0)[::-1]
    for x in a[sums[gap - a] > 0].tolist():
        counts[x] -= 1
        found = _pair(counts, gap - x, x)
        counts[x] += 1
        if found:
            return [x, *found]
    return None


def make_plan(histogram: dict[int, int], length: int = LENGTH) -> Plan:
    """The plan for so many pieces of each length; its size follows the number of lengths, not of pieces."""
    plan = Plan()
    counts = np.zeros(length + 1, np.int64)
    for x, n in histogram.items():
        if not 0 < x <= length:
            raise ValueError(f"a piece of {x} tokens")
        counts[x] = n
    sums = np.zeros(2 * length + 1, np.int64)
    for x in np.flatnonzero(counts):
        sums[x + np.flatnonzero(counts[: x + 1])] += 1

    def spend(x: int, n: int) -> None:
        counts[x] -= n
        if not counts[x]:  # its pairs are no longer there
            sums[x + np.flatnonzero(counts)] -= 1
            sums[2 * x] -= 1

    left: list[tuple[int, int]] = []
    for longest in range(length, 0, -1):
        while counts[longest]:
            if longest == length:
                group = [longest]
            else:
                counts[longest] -= 1
                rest = _complement(counts, sums, length - longest, longest)
                counts[longest] += 1
                if rest is None:
                    break
                group = [longest, *rest]
            n = min(int(counts[x]) // group.count(x) for x in group)
            plan.add(group, n)
            for x in set(group):
                spend(x, n * group.count(x))
        if counts[longest]:
            left.append((longest, int(counts[longest])))
            spend(longest, int(counts[longest]))

    # best fit, decreasing: open bins by their gap, each entry (first sequence, number)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
    for x, n in left:
        gap = x
        while n:
            while gap <= length and not gaps[gap]:
                gap += 1
            if gap > length:
                break
            first, many = gaps[gap].pop()
            used = min(n, many)
            plan._take(x, used, first, length - gap)
            gaps[gap - x].append((first, used))
            if many > used:
                gaps[gap].append((first + used, many - used))
            n -= used
        while n:
            each = length // x  # new bins take as many of this length as fit
            full = n // each
            if full:
                first = plan.add([x] * each, full)
                gaps[length - each * x].append((first, full))
                n -= full * each
            else:
                gaps[length - n * x].append((plan.add([x] * n, 1), 1))
                n = 0
    return plan


def _placer(entries: np.ndarray, names: list[str]):
    order = np.lexsort((entries[:, 1], entries[:, 0]))
    own = entries[order]
    code = (own[:, 0].astype(np.int64) << 48) | own[:, 1].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            key = (batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64) << 48) | rank
            at = np.searchsorted(code, key, side="right") - 1
            sequence, offset = own[at, 3] + (rank - own[at, 1]), own[at, 4]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence.astype(np.int64)), pa.array(offset.astype(np.int64))], names=[*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """Every row of pieces (with a column length of 1 to `length`) with its sequence_id and offset.

    The rows are written once, because they are counted before they are placed.
    """
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    p = private(pieces, "rank")
    stored = store(pieces.select(*names), "pieces")
    histogram = {r["length"]: r["n"] for r in stored.df.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `length` rows
    plan = make_plan(histogram, length)
    if not plan.entries:
        return stored.df.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    group_rows = max(LEAST_GROUP, stored.rows // GROUPS)
    shares = pieces.sparkSession.createDataFrame([(x, -(-n // group_rows)) for x, n in histogram.items()], f"`{p}length` int, `{p}salts` int")
    keyed = stored.df.join(F.broadcast(shares), F.col("length") == F.col(f"{p}length")).withColumn(f"{p}salt", F.pmod(F.xxhash64(*names), F.col(f"{p}salts")))
    before = Window.partitionBy("length").orderBy(f"{p}salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = keyed.groupBy("length", f"{p}salt").agg(F.count(F.lit(1)).alias("n"))  # at most GROUPS + `length` rows
    starts = F.broadcast(groups.select(F.col("length").alias(f"{p}l"), F.col(f"{p}salt").alias(f"{p}s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{p}before")))
    within = Window.partitionBy("length", f"{p}salt").orderBy(*names)
    ranked = keyed.withColumn(f"{p}r", F.row_number().over(within) - 1)
    ranked = ranked.join(starts, (F.col("length") == F.col(f"{p}l")) & (F.col(f"{p}salt") == F.col(f"{p}s"))).select(*names, (F.col(f"{p}before") + F.col(f"{p}r")).cast("long").alias("rank"))
    fields = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(_placer(np.array(plan.entries, np.int64), names), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of all documents with their places; with with_ids also the token ids themselves."""
    return pack(cut_into_pieces(docs, text=text, doc_id=doc_id, tokenizer=tokenizer, length=length, end_id=end_id, with_ids=with_ids, cache_words=cache_words), length=length)


def sequences(packed: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """sequence_id and its token ids, from packed rows with ids; a sequence has at most `length` tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
