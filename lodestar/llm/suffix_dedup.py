"""Exact removal of repeated long strings with a logarithmic family of suffix arrays.

A byte goes if a string of SPAN bytes that covers it also starts anywhere
else, in the same document or another, in the input as given.

1. Sampling, a prefilter. Every window of SPAN bytes points to an anchor, the
   position with the smallest hash among its CORE-grams. Equal windows have
   equal anchors, so windows can only repeat where the anchor's CORE-gram
   repeats. The windows of one anchor (some 120 in a row) are a run, the bytes
   they reach its hull. Runs whose gram occurs once are done. Equal hulls under
   one gram are one entry with the number of its copies.
2. Suffix arrays. The hulls of the entries go to shards by their gram. A shard
   takes them in batches; the window starts of a batch are sorted by the bytes
   that follow them, with the common prefix of neighbours (`SuffixArray`). A
   new array is merge-scanned against the levels of the family: each suffix
   finds its place in the level's order, and what it has in common with the
   neighbours there is a match if that is SPAN bytes or more, confirmed on the
   bytes. Levels of equal size are merged, so n suffixes have log(n) levels.
   A suffix that stands for several copies matches them.
3. Matched windows come back as byte ranges to every run of the entry, and by
   text hash and length to the documents, so copies of a text share one list of
   ranges and a text moves only when that list is too large to broadcast.

A gram with more than HOT_BYTES of different hulls (a passage that very many
documents hold between different neighbours) would overfill its shard; its
windows are counted by 128-bit names with partial aggregation instead, which
gives the same matches.

`SuffixIndex` keeps levels of runs and the texts in a shared folder: a new batch
is scanned against all of them, and levels of equal size are merged there too.

Defined cases: a null text is empty; texts under SPAN bytes lose nothing;
repeated rows are different documents and so repeat each other; ids may be
null or repeat, they are only carried; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _arrow as A
from ._store import Stored, bound_batches, private, store

SPAN, CORE = 400, 160
GRAMS = SPAN - CORE + 1
SHARD_BYTES, HOT_BYTES, BATCH_BYTES = 3 << 19, 2 << 20, 1 << 19
PAIRS = 1 << 17
_BYTE = A.byte_values(61)
_SECOND = A.byte_values(62)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, first start, number of starts, position, gram and hull of each anchor.

    Positions are relative to their document; the windows of an anchor start at consecutive bytes.
    """
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, A.U64),) * 2
    if len(data) < SPAN:
        return none
    values = _BYTE[data]
    at = np.arange(len(data) - CORE + 1)
    grams = A.span_hashes(values, at, at + CORE)
    # 32 bits of the hash, then the position: the leftmost of the smallest, whatever surrounds the window
    low = _sliding_min((grams & A.U64(0xFFFFFFFF00000000)) | at.astype(A.U64), GRAMS)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(low)]
    start = np.arange(len(low))
    start = start[start + SPAN <= end]
    if not len(start):
        return none
    anchor = (low[start] & A.U64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(offsets, start, side="right") - 1
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    a, p, d = start[first], anchor[first], doc[first]
    hull = A.span_hashes(values, a, a + count - 1 + SPAN)
    with np.errstate(over="ignore"):
        hull = A.mix(hull + (p - a).astype(A.U64) * A.U64(0x9E3779B97F4A7C15))
    return d, a - offsets[d], count, p - offsets[d], grams[p], hull


_RUN = "th long, n int, start int, count int, gram long, hull long"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = A.buffers(batch.column(0))
        for i, j in A.blocks(offsets):
            at = offsets[i : j + 1]
            doc, start, count, _, gram, hull = anchors(data[at[0] : at[-1]], at - at[0])
            which = pa.array(doc + i)
            columns = [batch.column(1).take(which), batch.column(2).take(which), *(pa.array(x.astype(np.int32)) for x in (start, count)), pa.array(A.signed(gram)), pa.array(A.signed(hull))]
            yield pa.RecordBatch.from_arrays(columns, names=["th", "n", "start", "count", "gram", "hull"])


class Buffer:
    """Bytes with the hash of any span and the eight bytes at any place in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.data = data
        self.total = np.zeros(n + 1, A.U64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * A._power_table(A._BASE, n + 1)[:n], out=self.total[1:])
        self.inverse = A._power_table(A._BASE_INVERSE, n + 1)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.words = padded[:n].astype(A.U64)
        for k in range(1, 8):
            self.words <<= A.U64(8)
            self.words |= padded[k : n + k]


def common_prefix(x: Buffer, p: np.ndarray, y: Buffer, q: np.ndarray, most: int) -> np.ndarray:
    """How many bytes, up to `most`, the suffixes of x at p have in common with those of y at q."""
    out = np.zeros(len(p), np.int16)
    for i in range(0, len(p), PAIRS):
        out[i : i + PAIRS] = _common_prefix(x, p[i : i + PAIRS], y, q[i : i + PAIRS], most)
    return out


def _common_prefix(x: Buffer, p: np.ndarray, y: Buffer, q: np.ndarray, most: int) -> np.ndarray:
    low, high = np.zeros(len(p), np.int64), np.full(len(p), most, np.int64)
    a, b, i, j = x.total[p], y.total[q], x.inverse[p], y.inverse[q]
    with np.errstate(over="ignore"):
        for _ in range(int(most).bit_length()):
            middle = (low + high + 1) >> 1
            same = (x.total[p + middle] - a) * i == (y.total[q + middle] - b) * j
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
    return low


def _equal_bytes(x: Buffer, p: np.ndarray, y: Buffer, q: np.ndarray, span: int) -> np.ndarray:
    """Whether `span` bytes are the same, byte for byte."""
    out = np.ones(len(p), bool)
    for k in [*range(0, span - 7, 8), max(span - 8, 0)] if span >= 8 else ():
        out &= x.words[p + k] == y.words[q + k]
    return out


class SuffixArray:
    """Suffixes of a buffer in the order of their first `span` bytes, each known by an owner and matched or not yet.

    places: where the suffixes start, each with at least `span` bytes after it; common[i]: the common prefix of
    suffixes i - 1 and i, up to `span`.
    """

    def __init__(self, buffer: Buffer, places: np.ndarray, owner: np.ndarray, matched: np.ndarray, common: np.ndarray, span: int):
        self.buffer, self.places, self.owner, self.matched, self.common, self.span = buffer, places, owner, matched, common, span

    @classmethod
    def build(cls, data: np.ndarray, places: np.ndarray, owner: np.ndarray, matched: np.ndarray, span: int) -> SuffixArray:
        buffer = Buffer(data)
        order = _suffix_order(buffer, places, span)
        out = cls(buffer, places[order], owner[order], matched[order], np.zeros(len(order), np.int16), span)
        out.common[1:] = common_prefix(buffer, out.places[:-1], buffer, out.places[1:], span)
        hit = np.flatnonzero(out.common >= span)
        hit = hit[_equal_bytes(buffer, out.places[hit - 1], buffer, out.places[hit], span)]
        out.matched[hit] = out.matched[hit - 1] = True
        return out

    def places_of(self, other: SuffixArray) -> np.ndarray:
        """For each suffix of the other array, how many of this one's come before it."""
        mine, theirs = self.buffer.words[self.places], other.buffer.words[other.places]
        low, high = np.searchsorted(mine, theirs, side="left"), np.searchsorted(mine, theirs, side="right")
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            p, q = self.places[middle], other.places[open_]
            n = common_prefix(self.buffer, p, other.buffer, q, self.span)
            last = np.minimum(n, self.span - 1)
            before = (n < self.span) & (self.buffer.words[p + last] < other.buffer.words[q + last])
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        return low

    def scan(self, other: SuffixArray) -> None:
        """Mark the suffixes of both arrays that have `span` bytes in common with one of the other array.

        Equal suffixes stand together and those of one array know each other, so the neighbours decide.
        """
        if not len(self.places) or not len(other.places):
            return
        at = self.places_of(other)
        for neighbour in (at - 1, at):
            rows = np.flatnonzero((neighbour >= 0) & (neighbour < len(self.places)))
            mine = neighbour[rows]
            p, q = self.places[mine], other.places[rows]
            rows, mine, p, q = (v[self.buffer.words[p] == other.buffer.words[q]] for v in (rows, mine, p, q))
            hit = common_prefix(self.buffer, p, other.buffer, q, self.span) >= self.span
            hit[hit] = _equal_bytes(self.buffer, p[hit], other.buffer, q[hit], self.span)
            self.matched[mine[hit]] = True
            other.matched[rows[hit]] = True

    def merge(self, other: SuffixArray) -> SuffixArray:
        """One array of both; only pairs that became neighbours are compared again."""
        slot = self.places_of(other) + np.arange(len(other.places))
        fresh = np.zeros(len(self.places) + len(other.places), bool)
        fresh[slot] = True

        def both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.empty(len(fresh), x.dtype)
            out[fresh], out[~fresh] = y, x
            return out

        buffer = Buffer(np.concatenate([self.buffer.data, other.buffer.data]))
        out = SuffixArray(buffer, both(self.places, other.places + len(self.buffer.data)), both(self.owner, other.owner), both(self.matched, other.matched), both(self.common, other.common), self.span)
        new = np.flatnonzero(fresh[1:] | fresh[:-1]) + 1
        out.common[new] = common_prefix(buffer, out.places[new - 1], buffer, out.places[new], self.span)
        return out


def _suffix_order(buffer: Buffer, places: np.ndarray, span: int) -> np.ndarray:
    """The order of the suffixes by their first `span` bytes.

    Sorted by eight bytes; a group of ties skips to the end of its common prefix and is sorted by the next eight there.
    """
    order = np.argsort(buffer.words[places], kind="stable")
    first = buffer.words[places[order]]
    tied = np.zeros(len(order) + 1, bool)  # tied[i]: suffix i ties with i - 1
    tied[1:-1] = first[1:] == first[:-1]
    open_ = np.ones(len(order), bool)
    while True:
        rows = np.flatnonzero((tied[:-1] | tied[1:]) & open_)
        if not len(rows):
            return order
        at, new = places[order[rows]], ~tied[rows]
        group = np.cumsum(new) - 1
        n = np.full(len(rows), span, np.int16)
        inner = np.flatnonzero(~new)
        n[inner] = common_prefix(buffer, at[inner - 1], buffer, at[inner], span)
        depth = np.minimum.reduceat(n, np.flatnonzero(new))[group]
        open_[rows[depth >= span]] = False  # equal suffixes
        go = depth < span
        rows, group = rows[go], group[go]
        key = buffer.words[at[go] + depth[go]]
        within = np.lexsort((key, group))
        order[rows] = order[rows][within]
        key = key[within]
        tied[rows] = False
        same = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        tied[rows[1:][same]] = True


class SuffixFamily:
    """Levels of suffix arrays, each less than half as long as the one below it."""

    def __init__(self, span: int = SPAN):
        self.levels: list[SuffixArray] = []
        self.span = span

    def add(self, data: np.ndarray, places: np.ndarray, owner: np.ndarray, matched: np.ndarray) -> None:
        """A batch of suffixes: it is scanned against every level, then becomes one."""
        new = SuffixArray.build(data, places, owner, matched, self.span)
        for level in self.levels:
            level.scan(new)
        self.levels.append(new)
        while len(self.levels) > 1 and 2 * len(self.levels[-1].places) >= len(self.levels[-2].places):
            above, below = self.levels.pop(), self.levels.pop()
            self.levels.append(below.merge(above))

    def matched(self) -> np.ndarray:
        """Owners of the matched suffixes, in order."""
        found = [level.owner[level.matched] for level in self.levels]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


_HULL = "gram long, hull long, copies long, bytes binary"
_MATCH = "gram long, hull long, a int, b int"


def _hull_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their entries (start, count, gram, hull, copies): the bytes of each entry's hull, from one copy of a text in each task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        texts = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
        fresh = [i for i, x in enumerate(texts) if not (x in seen or seen.add(x))]
        if len(fresh) < len(texts):
            batch = batch.take(pa.array(fresh, pa.int64()))
        data, offsets = A.buffers(batch.column(0))
        entries = batch.column(1).combine_chunks() if isinstance(batch.column(1), pa.ChunkedArray) else batch.column(1)
        ends, flat = entries.offsets.to_numpy().astype(np.int64), entries.values
        start, count, gram, hull, copies = (flat.field(k).to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] for k in range(5))
        doc = np.searchsorted(ends, np.arange(ends[0], ends[-1]), side="right") - 1
        a = offsets[doc] + start
        b = a + count + SPAN - 1
        for i in range(0, len(a), 2000):
            cut = slice(i, i + 2000)
            size = b[cut] - a[cut]
            at = np.concatenate([[0], np.cumsum(size)])
            take = np.repeat(a[cut] - at[:-1], size) + np.arange(at[-1])
            held = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[take])])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[cut]) for x in (gram, hull, copies)), held], names=["gram", "hull", "copies", "bytes"])


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hulls of one shard: the runs of matched window starts of each, as byte ranges from the hull's start."""
    family, parts, held, size, before = SuffixFamily(), [], [], 0, 0

    def feed() -> None:
        nonlocal held, size, before
        data = np.concatenate([d for d, _, _ in held])
        lengths = np.concatenate([n for _, n, _ in held])
        copies = np.concatenate([c for _, _, c in held])
        starts = lengths - SPAN + 1
        first = np.cumsum(lengths) - lengths
        owner = np.repeat(before + np.cumsum(starts) - starts, starts) + (np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts))
        places = np.repeat(first - np.cumsum(starts) + starts, starts) + np.arange(starts.sum())
        family.add(data, places, owner, np.repeat(copies > 1, starts))
        before += int(starts.sum())
        held, size = [], 0

    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        fresh = [i for i, x in enumerate(keys) if not (x in seen or seen.add(x))]  # copies of a text come from several tasks
        if len(fresh) < len(keys):
            batch = batch.take(pa.array(fresh, pa.int64()))
        data, offsets = A.buffers(batch.column(3))
        copies = batch.column(2).to_numpy(zero_copy_only=False)
        parts.append((batch.column(0), batch.column(1), np.diff(offsets) - SPAN + 1))
        for i, j in A.blocks(offsets, BATCH_BYTES):
            held.append((data[offsets[i] : offsets[j]], np.diff(offsets[i : j + 1]), copies[i:j]))
            size += int(offsets[j] - offsets[i])
            if size >= BATCH_BYTES:
                feed()
    if held:
        feed()
    if not parts:
        return
    found = family.matched()  # window starts, numbered through all hulls
    counts = np.concatenate([c for _, _, c in parts])
    begin = np.cumsum(counts) - counts
    which = np.searchsorted(begin, found, side="right") - 1
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1] + 1) | (which[1:] != which[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(found))[: len(head)] - 1
    gram, hull = (pa.concat_arrays([p[k].combine_chunks() if isinstance(p[k], pa.ChunkedArray) else p[k] for p in parts]) for k in range(2))
    entry = pa.array(which[head])
    a, b = found[head] - begin[which[head]], found[last] - begin[which[head]] + SPAN
    whole = pa.RecordBatch.from_arrays([gram.take(entry), hull.take(entry), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["gram", "hull", "a", "b"])
    for i in range(0, len(whole), 100_000):
        yield whole.slice(i, 100_000)


def _window_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hulls of hot grams: one row for each window, with its 128-bit name."""
    for batch in batches:
        data, offsets = A.buffers(batch.column(3))
        for i, j in A.blocks(offsets, 1 << 18):
            at = offsets[i : j + 1] - offsets[i]
            part = data[offsets[i] : offsets[j]]
            counts = np.diff(at) - SPAN + 1
            k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            which = np.repeat(np.arange(j - i), counts)
            start = at[which] + k
            names = [pa.array(A.signed(A.span_hashes(v[part], start, start + SPAN))) for v in (_BYTE, _SECOND)]
            keys = [batch.column(c).take(pa.array(which + i)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(k.astype(np.int32)), *names], names=["gram", "hull", "copies", "k", "n1", "n2"])


def _hot_matches(hulls: DataFrame) -> DataFrame:
    """_MATCH rows of the grams that are too large for a shard: windows that occur twice, by name."""
    names = store(hulls.mapInArrow(_window_names, "gram long, hull long, copies long, k int, n1 long, n2 long"), "window-names")
    repeated = store(names.df.groupBy("n1", "n2").agg(F.sum("copies").alias("c")).where("c > 1").select(F.col("n1").alias("m1"), F.col("n2").alias("m2")), "repeated-names")
    hits = names.df.join(repeated.side(), (F.col("n1") == F.col("m1")) & (F.col("n2") == F.col("m2")), "left_semi")
    return hits.select("gram", "hull", F.col("k").alias("a"), (F.col("k") + SPAN).alias("b"))


def _runs(texts: DataFrame) -> DataFrame:
    return texts.where(F.col("n") >= SPAN).mapInArrow(_anchor_rows, _RUN)


def _matches(runs: DataFrame, texts: DataFrame, grams: Stored) -> DataFrame:
    """th, n, a, b: the repeated byte ranges of all runs with these grams (g); runs and texts may repeat a text."""
    shared = store(runs.join(grams.side(), F.col("gram") == F.col("g")).drop("g"), "shared-runs")
    entries = shared.df.groupBy("gram", "hull").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("th", "n", "start", "count")).alias("one"))
    entries = store(entries, "entries")
    size = F.col("one.count") + F.lit(SPAN - 1)
    bytes_ = entries.df.agg(F.sum(size)).first()[0] or 0
    per_gram = entries.df.groupBy("gram").agg(F.sum(size).alias("size")).where(F.col("size") > HOT_BYTES).select(F.col("gram").alias("hot"))
    hot = store(per_gram, "hot-grams")
    wanted = entries.df.groupBy(F.col("one.th").alias("th2"), F.col("one.n").alias("n2")).agg(F.collect_list(F.struct("one.start", "one.count", "gram", "hull", "copies")).alias("entries"))
    wanted = store(wanted, "wanted-hulls")
    owners = texts.join(wanted.side(), (F.col("th") == F.col("th2")) & (F.col("n") == F.col("n2")))
    hulls = owners.select("t", "entries", "th", "n").mapInArrow(_hull_rows, _HULL)
    shards = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // SHARD_BYTES))
    if hot.rows:
        hulls = store(hulls, "hulls").df
        crowded = hulls.join(hot.side(), F.col("gram") == F.col("hot"), "left_semi").groupBy("gram", "hull").agg(F.any_value("copies").alias("copies"), F.any_value("bytes").alias("bytes"))
        hulls = hulls.join(hot.side(), F.col("gram") == F.col("hot"), "left_anti")
    found = hulls.repartition(shards, "gram").mapInArrow(_shard_rows, _MATCH)
    if hot.rows:
        found = found.union(_hot_matches(crowded))
    spans = store(found.groupBy("gram", "hull").agg(F.collect_list(F.struct("a", "b")).alias("spans")).select(F.col("gram").alias("g"), F.col("hull").alias("h"), "spans"), "matches")
    marked = shared.df.join(spans.side(), (F.col("gram") == F.col("g")) & (F.col("hull") == F.col("h"))).select("th", "n", "start", "spans")
    once = marked.groupBy("th", "n", "start").agg(F.any_value("spans").alias("spans"))  # copies of a text mark the same ranges
    return once.select("th", "n", "start", F.explode("spans").alias("s")).select("th", "n", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))


def _by_text(ranges: DataFrame) -> DataFrame:
    spans = ranges.groupBy("th", "n").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    return spans.mapInArrow(_merge, "th long, n int, spans array<struct<a:int,b:int>>")


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """th, n and spans (byte ranges to remove) of every text, given as rows (t, th, n), that holds a repeated window."""
    texts = texts.select("t", "th", "n")
    runs = store(_runs(texts), "runs")
    grams = store(runs.df.groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g"), "shared-grams")
    return _by_text(_matches(runs.df, texts, grams))


class SuffixIndex:
    """An index of texts in the shared folder that takes new batches.

    A level is a table of runs, sorted by gram; texts are written once. add() scans a batch against all levels.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[Stored] = []
        self.texts: list[Stored] = []

    def add(self, texts: DataFrame) -> DataFrame:
        """Byte ranges (th, n, spans) that repeat because of this batch, of its texts and of earlier ones; rows (t, th, n)."""
        kept = store(texts.select("t", "th", "n"), "index-texts")
        new = store(_runs(kept.df).sort("gram"), "index-level")
        older = [level.df for level in self.levels]
        seen = new.df.groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("c"))
        for level in older:
            seen = seen.unionByName(level.join(new.df.select("gram").distinct(), "gram", "left_semi").groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("c")))
        grams = store(seen.groupBy("g").agg(F.sum("c").alias("c")).where("c > 1").select("g"), "shared-grams")
        self.texts.append(kept)
        runs, held = new.df, self.texts[0].df
        for level in older:
            runs = runs.unionByName(level)
        for part in self.texts[1:]:
            held = held.unionByName(part.df)
        found = store(_by_text(_matches(runs, held, grams)), "index-matches").df
        self.levels.append(new)
        while len(self.levels) > 1 and 2 * self.levels[-1].rows >= self.levels[-2].rows:
            above, below = self.levels.pop(), self.levels.pop()
            self.levels.append(store(below.df.unionByName(above.df).sort("gram"), "index-level"))
            above.drop()
            below.drop()
        return found


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ranges of each row, those that touch joined into one."""
    for batch in batches:
        spans = batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2)
        ends = spans.offsets.to_numpy().astype(np.int64)
        flat = spans.values
        row = np.searchsorted(ends, np.arange(ends[0], ends[-1]), side="right") - 1
        a, b = (flat.field(k).to_numpy()[ends[0] : ends[-1]].astype(np.int64) for k in range(2))
        lift = row << 33  # keeps rows apart in one running maximum
        reach = np.maximum.accumulate(b + lift) if len(b) else b
        new = np.ones(len(a), bool)
        new[1:] = (a + lift)[1:] > reach[:-1]
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(a)) - 1
        merged = pa.StructArray.from_arrays([pa.array(a[head].astype(np.int32)), pa.array((reach[last] - lift[last]).astype(np.int32))] if len(a) else [pa.array([], pa.int32())] * 2, ["a", "b"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), A.lists(merged, np.searchsorted(row[head], np.arange(len(batch) + 1)))], names=["th", "n", "spans"])


def _cut(keep: list[str], with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, digests, kept = [], [], [], []
            for value, spans in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                parts, at, gone, n = [], 0, 0, 0
                end = -1
                for s in spans or ():
                    if s["a"] > end:  # ranges that touch make one run
                        if n:
                            at = end
                        parts.append(data[at : s["a"]])
                        n, begin, end = n + 1, s["a"], s["b"]
                        gone += end - begin
                    elif s["b"] > end:
                        gone += s["b"] - end
                        end = s["b"]
                parts.append(data[max(end, 0) :])
                left = b"".join(parts) if n else data
                removed.append(gone)
                runs.append(n)
                digests.append(hashlib.sha256(left).hexdigest())
                if with_kept:
                    kept.append(left)
            columns = [*batch.columns[2:], pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
            names = [*keep, "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())] if with_kept else columns, names=[*names, "kept"] if with_kept else names)

    return run


def remove_repeats(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, with_kept: bool = True) -> DataFrame:
    """The kept columns of every row (default: all), n_bytes, n_removed, n_spans, kept_sha256 and, with with_kept, the kept bytes.

    Ranges are cut by byte and may split a character, so `kept` is binary. Clashing names are replaced.
    """
    bound_batches(docs.sparkSession)
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else [])]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    p = private(docs, *added)
    names = [f"{p}{i}" for i in range(len(keep))]
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    rows = rows.withColumns({"th": F.xxhash64("t"), "n": F.octet_length("t")})
    ranges = store(repeated_ranges(rows.select("t", "th", "n")).select(F.col("th").alias("th2"), F.col("n").alias("n2"), "spans"), "repeats")
    joined = rows.join(ranges.side(), (F.col("th") == F.col("th2")) & (F.col("n") == F.col("n2")), "left")
    fields = "".join(f"`{n}` {docs.schema[c].dataType.simpleString()}, " for c, n in zip(keep, names, strict=True))
    out = joined.select(F.col("t").cast("binary").alias("t"), "spans", *names, F.col("n").alias(f"{p}bytes")).mapInArrow(
        _cut([*names, f"{p}bytes"], with_kept), f"{fields}`{p}bytes` int, n_removed long, n_spans long, kept_sha256 string{', kept binary' if with_kept else ''}"
    )
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.col(f"{p}bytes").cast("long").alias("n_bytes"), *added[1:])
