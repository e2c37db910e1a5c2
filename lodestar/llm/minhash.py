"""MinHash near-duplicates found by a multi-index Hamming join.

A document's set holds its distinct shingles of WORDS words. Its signature is
CHUNKS x SYMBOLS min-hashes of BITS bits, and its sketch one further bit of
each of SKETCH min-hashes. Two signatures that differ in at most DISTANCE
places have, by the pigeonhole principle, a chunk that differs in at most
ERRORS places; so each chunk is indexed once for every choice of ERRORS places
left out, and any such pair meets in a bucket. (Sets with a similarity of 0.75
differ in 10 of the 40 places on average; a pair at exactly 0.75 meets with
probability 1 - 2e-6.) Candidates are confirmed on their full sets.

Equal sets are one node from the start, however many copies there are. Nobody
emits all pairs of a bucket: each member is first compared with the bucket's
leader, the member that shares the largest buckets with others and so lies in
the middle of its group; a group of near copies thus takes a number of pairs
that is linear in its size. Members that still lie in different components are
then joined exactly, by prefix filter: of two sets that are similar enough,
each has one of the other's elements among its rarest (1 - 0.75) n + 1 ones.
Size and sketch are compared inside that join, so just plausible pairs come
out, and elements whose sets all lie in one component are left out. Groups above
COLD rows are compared in blocks of bounded size.

Defined cases: null or wordless documents have no set, are linked with nothing
and kept; fewer words than WORDS make one shingle; null ids take part and are
passed over when the smallest id is sought; rows of one id and text are one
document; nodes are 64-bit names of sets, and sets that share a name by chance
are told apart by 64 further bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _arrow as A
from ._store import Stored, bound_batches, private, store
from .components import components

WORDS, PERCENT = 5, 75
CHUNKS, SYMBOLS, ERRORS, BITS = 10, 4, 1, 32
DISTANCE = CHUNKS * (ERRORS + 1) - 1
SKETCH, SKETCH_DISTANCE = 128, 36
COLD, BLOCK, HUB = 256, 2048, 256
NAME_BITS = 64

_WORD = A.byte_values(41, lower=True)
_FACTORS = (A.stream(42, SKETCH) >> A.U64(32)).astype(np.uint32) | np.uint32(1)
_OFFSETS = (A.stream(43, SKETCH) >> A.U64(32)).astype(np.uint32)
_BITS = (A.stream(44, SKETCH) >> A.U64(32)).astype(np.uint32) | np.uint32(1)
_KEYS = A.stream(45, CHUNKS * SYMBOLS * SYMBOLS).reshape(CHUNKS * SYMBOLS, SYMBOLS) | A.U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and the index of each document's first one."""
    starts, ends = A.bounds(~A.SPACES[data], offsets)
    words, first = A.span_hashes(_WORD[data], starts, ends), A.per_document(starts, offsets)
    h, at = A.windows(words, first, WORDS, 46)
    doc = np.searchsorted(first, at, side="right") - 1
    n = np.diff(first)
    few = np.flatnonzero((n > 0) & (n < WORDS))
    h = np.concatenate([h, A.span_hashes(words, first[few], first[few + 1])])
    doc = np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For non-empty sets: CHUNKS * SYMBOLS bucket keys each, and the sketches as two numbers each."""
    seg = first[:-1][np.diff(first) > 0]
    low = (h >> A.U64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        mins = np.stack([np.minimum.reduceat(low * f + o, seg) for f, o in zip(_FACTORS, _OFFSETS, strict=True)], axis=1)
        bits = ((mins * _BITS) >> np.uint32(31)).astype(np.uint8)
        symbols = mins[:, : CHUNKS * SYMBOLS].astype(A.U64) >> A.U64(32 - BITS)
        keys = np.empty((len(seg), CHUNKS * SYMBOLS), A.U64)
        for c in range(CHUNKS):
            for out in range(SYMBOLS):
                k = c * SYMBOLS + out
                total = np.full(len(seg), k, A.U64)
                for s in range(SYMBOLS):
                    if s != out:
                        total += A.mix(symbols[:, c * SYMBOLS + s] + _KEYS[k, s])
                        total *= _KEYS[k, s]
                keys[:, k] = A.mix(total)
    return keys, np.packbits(bits, axis=1).view(np.int64).reshape(len(seg), SKETCH // 64)


def set_names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits that name each non-empty set, as two columns; sums, because a set has no order."""
    seg = first[:-1][np.diff(first) > 0]
    size = np.diff(np.append(seg, len(h))).astype(A.U64)
    with np.errstate(over="ignore"):
        return np.stack([A.mix(np.add.reduceat(A.mix(h ^ A.U64(salt)), seg) + size) for salt in (0xA5A5A5A5, 0x5A5A5A5A5A)], axis=1)


def _features(bits: int):
    mask = A.U64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.buffers(batch.column(0))
            for i, j in A.blocks(offsets):
                at = offsets[i : j + 1]
                h, first = shingle_sets(data[at[0] : at[-1]], at - at[0])
                n = np.diff(first)
                some = n > 0
                name, keys, sketch = np.zeros((2, j - i), np.int64), np.zeros((0, CHUNKS * SYMBOLS), np.int64), np.zeros((j - i, 2), np.int64)
                if some.any():
                    k, sk = signatures(h, first)
                    own = set_names(h, first)
                    name[0, some], name[1, some], keys, sketch[some] = A.signed(own[:, 0] & mask), A.signed(own[:, 1].copy()), A.signed(k), sk
                ends = np.concatenate([[0], np.cumsum(np.where(some, CHUNKS * SYMBOLS, 0))])
                sid, check = (pa.array(x, mask=~some) for x in name)
                columns = [batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n.astype(np.int64)), sid, check, A.lists(pa.array(keys.ravel()), ends), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "n", "sid", "check", "keys", "s1", "s2"])

    return run


def _sets(bits: int):
    mask = A.U64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.buffers(batch.column(0))
            for i, j in A.blocks(offsets):
                at = offsets[i : j + 1]
                h, first = shingle_sets(data[at[0] : at[-1]], at - at[0])
                some = np.diff(first) > 0
                if some.any():
                    own, seg = set_names(h, first), first[:-1][some]
                    yield pa.RecordBatch.from_arrays([pa.array(A.signed(own[:, 0] & mask)), pa.array(A.signed(own[:, 1].copy())), A.lists(pa.array(A.signed(h)), np.append(seg, len(h)))], names=["sid", "check", "h"])

    return run


def _plausible(n1: Column, n2: Column, a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return (100 * F.least(n1, n2) >= PERCENT * F.greatest(n1, n2)) & (F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2)) <= SKETCH_DISTANCE)


@dataclass
class _Corpus:
    """Rows (t, th, id), their sets by name, and names that two different sets share."""

    rows: DataFrame
    clashes: Stored
    bits: int

    def named(self, df: DataFrame) -> DataFrame:
        """df (sid, check, ...) with a name of its own for each set that shares its 64 bits with another."""
        if not self.clashes.rows:
            return df.drop("check")
        met = df.join(self.clashes.side(), F.col("sid") == F.col("clash"), "left")
        return met.withColumn("sid", F.when(F.col("clash").isNull(), F.col("sid")).otherwise(F.xxhash64("sid", "check"))).drop("clash", "check")

    def sets_of(self, sids: DataFrame, nodes: DataFrame) -> DataFrame:
        """sid and the full set h of the wanted nodes, read again from one document of each."""
        wanted = store(sids.join(nodes.select("sid", "rep", "rep_th"), "sid").select(F.col("rep").alias("w"), F.col("rep_th").alias("w_th")).distinct(), "wanted")
        rows = self.rows.join(wanted.side(), F.col("id").eqNullSafe(F.col("w")) & (F.col("th") == F.col("w_th")), "left_semi")
        return self.named(rows.select("t").mapInArrow(_sets(self.bits), "sid long, check long, h array<long>")).groupBy("sid").agg(F.any_value("h").alias("h"))


def _confirm(pairs: DataFrame, corpus: _Corpus, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough.

    A node with many pairs is dealt over parts of at most HUB of them, each with a copy of its set.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("c"))
    parts = store(ends.select("sid", F.ceil(F.col("c") / HUB).cast("int").alias("parts")), "pair-counts")
    sets = store(corpus.sets_of(parts.df.select("sid"), nodes).join(parts.df, "sid"), "pair-sets")
    hubs = store(parts.df.where("parts > 1").withColumnRenamed("sid", "hub"), "hubs")
    for end, other in ("ab", "ba"):
        dealt = pairs.join(hubs.side().withColumnRenamed("parts", f"p{end}"), F.col(end) == F.col("hub"), "left").drop("hub") if hubs.rows else pairs.withColumn(f"p{end}", F.lit(1))
        pairs = dealt.withColumn(f"part_{end}", F.when(F.col(f"p{end}") > 1, F.pmod(F.xxhash64(other), F.col(f"p{end}"))).otherwise(0).cast("int")).drop(f"p{end}")
    for end in "ab":
        side = sets.df.select(F.col("sid").alias(end), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{end}"), F.col("h").alias(f"h{end}"))
        pairs = pairs.join(side, [end, f"part_{end}"])
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.where(100 * both >= PERCENT * (F.size("ha") + F.size("hb") - both)).select("a", "b")


def _rarest(sets: DataFrame) -> DataFrame:
    """key, sid and rank (from 1): of each set, the elements of its prefix, rarest first, that other sets have too."""
    rows = sets.select("sid", F.size("h").alias("size"), F.explode("h").alias("key"))
    common = store(rows.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select(F.col("key").alias("common"), "df"), "common-shingles")
    ranked = rows.join(common.side(), F.col("key") == F.col("common"), "left").withColumn("rank", F.row_number().over(Window.partitionBy("sid").orderBy(F.coalesce("df", F.lit(1)), "key")))
    return ranked.where((100 * (F.col("rank") - 1) <= (100 - PERCENT) * F.col("size")) & F.col("df").isNotNull()).select("key", "sid", "rank")


def _meet(rows: DataFrame) -> DataFrame:
    """Plausible pairs of different components among rows (key, sid, rank, n, s1, s2, root) with one key.

    If a pair's first common element has these ranks, no more than what follows can be common.
    """
    x, y = rows.alias("x"), rows.alias("y")
    c = lambda t, k: F.col(f"{t}.{k}")
    near = _plausible(c("x", "n"), c("y", "n"), c("x", "s1"), c("x", "s2"), c("y", "s1"), c("y", "s2"))
    most = F.least(c("x", "n") - c("x", "rank"), c("y", "n") - c("y", "rank")) + 1
    near &= (100 + PERCENT) * most >= PERCENT * (c("x", "n") + c("y", "n"))
    return x.join(y, (c("x", "key") == c("y", "key")) & (c("x", "sid") < c("y", "sid")) & (c("x", "root") != c("y", "root")) & near).select(c("x", "sid").alias("a"), c("y", "sid").alias("b"))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """_meet for keys with c members, any number: every pair of blocks of about BLOCK members is a key of its own."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    mine = rows.withColumns({"blocks": blocks, "mine": F.pmod(F.xxhash64("sid"), blocks)})
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _meet(dealt.withColumn("key", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).drop("blocks", "mine", "other"))


@dataclass
class Links:
    """Features of every row (id, th, n, sid, ...), the nodes (sid, rep, rep_th, copies, ...), and the links (a, b) between nodes.

    met: links whose ends met in a bucket and were compared with its leader; the others come from the join of open bucket members.
    """

    features: DataFrame
    nodes: DataFrame
    links: DataFrame
    met: DataFrame


def near_duplicate_links(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", name_bits: int = NAME_BITS) -> Links:
    """All confirmed links. Two sets whose names agree in name_bits bits are told apart by 64 bits more."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("t"), F.col(doc_id).alias("id")).withColumn("th", F.xxhash64("t"))
    kind = docs.schema[doc_id].dataType.simpleString()
    raw = store(rows.select("t", "id", "th").mapInArrow(_features(name_bits), f"id {kind}, th long, n long, sid long, check long, keys array<long>, s1 long, s2 long"), "minhash").df
    clashes = raw.where("n > 0").groupBy("sid").agg(F.min("check").alias("c1"), F.max("check").alias("c2")).where("c1 <> c2").select(F.col("sid").alias("clash"))
    corpus = _Corpus(rows, store(clashes, "clashes"), name_bits)
    features = corpus.named(raw)
    one = lambda *names: [F.any_value(c).alias(c) for c in names]
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("first")
    nodes = features.where("n > 0").groupBy("sid").agg(first, F.count(F.lit(1)).alias("copies"), *one("n", "keys", "s1", "s2"))
    nodes = store(nodes.select("sid", F.col("first.id").alias("rep"), F.col("first.th").alias("rep_th"), "copies", "n", "keys", "s1", "s2"), "nodes").df
    indexed = nodes.select("sid", F.explode("keys").alias("key"))
    buckets = store(indexed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("c > 1"), "buckets")
    larger = store(buckets.df.where("c > 2").select("key", "c"), "larger-buckets")
    members = store(indexed.select("key", "sid").join(larger.side(), "key"), "members")

    # the middle of each larger bucket: the member that shares the most rows with others, over all its buckets
    weight = store(members.df.groupBy("sid").agg(F.sum("c").alias("w")).select(F.col("sid").alias("member"), "w"), "weights")
    weighted = members.df.join(weight.side(), F.col("sid") == F.col("member"))
    leaders = store(weighted.groupBy("key").agg(F.max(F.struct("w", "sid")).alias("l")).select(F.col("key").alias("led"), F.col("l.sid").alias("leader")), "leaders")
    stars = members.df.join(leaders.side(), F.col("key") == F.col("led")).where("sid <> leader").select("leader", "sid")

    pairs = buckets.df.where("c = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    pairs = pairs.union(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sketches = nodes.select("sid", "n", "s1", "s2")
    for end in "ab":
        pairs = pairs.join(sketches.select(*[F.col(c).alias(f"{end}{'' if c == 'sid' else '_' + c}") for c in sketches.columns]), end)
    pairs = store(pairs.where(_plausible(*[F.col(c) for c in ("a_n", "b_n", "a_s1", "a_s2", "b_s1", "b_s2")])).select("a", "b"), "pairs")
    links = store(_confirm(pairs.df, corpus, nodes), "links").df

    # members of one bucket that the stars left in different components
    roots = store(components(links), "roots")
    rooted = lambda df: df.join(roots.side(), F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid")).drop("node")
    mixed_keys = lambda df: df.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select(F.col("key").alias("mixed"), "c")
    placed = rooted(members.df.select("key", "sid"))
    mixed = store(mixed_keys(placed), "mixed")
    if not mixed.rows:
        return Links(features, nodes, links, links)
    open_sids = placed.join(mixed.side(), F.col("key") == F.col("mixed"), "left_semi").select("sid").distinct()
    prefixes = store(rooted(_rarest(corpus.sets_of(open_sids, nodes))), "prefixes")
    crowded = store(mixed_keys(prefixes.df), "mixed-prefixes")
    meeting = prefixes.df.join(crowded.side(), F.col("key") == F.col("mixed")).drop("mixed").join(sketches, "sid")
    found = _meet(meeting.where(F.col("c") <= COLD)).union(_in_blocks(meeting.where(F.col("c") > COLD)))
    more = store(found.distinct(), "pairs")
    if not more.rows:
        return Links(features, nodes, links, links)
    return Links(features, nodes, store(links.union(_confirm(more.df, corpus, nodes)).distinct(), "links").df, links)


def _grouped(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, th, n and sid of every row, and of rows in a class of several: the class, its smallest id, and id and text hash of the row it keeps."""
    found = near_duplicate_links(docs, text=text, doc_id=doc_id)
    roots = store(components(found.links), "roots")
    several = found.nodes.select("sid", "rep", "rep_th", "copies").join(roots.side(), F.col("sid") == F.col("node"), "left").where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "sid"))
    several = store(several, "classes")
    lowest = several.df.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("last"), "rep", "rep_th")).alias("low"))
    classes = store(several.df.join(lowest, "root").select(F.col("sid").alias("class"), F.col("low.rep").alias("low"), F.col("low.rep_th").alias("low_th")), "classes")
    return found.features.select("id", "th", "n", "sid").join(classes.side(), F.col("sid") == F.col("class"), "left")


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    label = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("low"))
    return _grouped(docs, text, doc_id).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), label.alias("component_id"), F.col("id").eqNullSafe(label).alias("kept"))


def deduplicate(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns unchanged, of which each component keeps the one with the smallest id.

    Rows are told apart by id and text, so a repeated id loses only those texts
    that are copies; of rows with the kept id and text one stays, the smallest
    one as JSON. Rows without a set all stay.
    """
    p = private(docs)
    grouped = store(_grouped(docs, text, doc_id).where("class is not null"), "grouped")
    same = F.col("id").eqNullSafe(F.col("low")) & (F.col("th") == F.col("low_th"))
    dropped = store(grouped.df.where(~same).select(F.col("id").alias(f"{p}id"), F.col("th").alias(f"{p}th")).distinct(), "dropped")
    repeated = store(grouped.df.where(same).groupBy(F.col("id").alias(f"{p}id"), F.col("th").alias(f"{p}th")).agg(F.count(F.lit(1)).alias(f"{p}c")).where(f"`{p}c` > 1").drop(f"{p}c"), "repeated")
    at = F.col(doc_id).eqNullSafe(F.col(f"{p}id")) & F.xxhash64(F.col(text).cast("string")).eqNullSafe(F.col(f"{p}th"))
    out = docs.join(dropped.side(), at, "left_anti")
    if not repeated.rows:
        return out
    keyed = out.join(repeated.side(), at, "inner")
    whole = F.struct(*[F.col(c).alias(c) for c in docs.columns])
    chosen = keyed.groupBy(f"{p}id", f"{p}th").agg(F.min_by(whole, F.to_json(whole)).alias(f"{p}row"))
    return out.join(repeated.side(), at, "left_anti").unionByName(chosen.select(f"{p}row.*"))
