"""Quality rules by cross-document line frequency.

Each line is normalised (white space trimmed and squeezed, A-Z folded, digits
masked) and hashed; distinct lines of a document are counted once per host. A
line found in more than ``max(min_docs, share * documents of the host)``
documents of its host is boilerplate there and is removed; a document that
keeps less than ``min_left`` of its words is depleted and rejected.

A host has at most (its lines / its limit) boilerplate lines, so the set per
host does not grow with the number of its documents. Counts are combined on
the map side, so neither a hot host nor a hot line gathers rows in one task.

Defined cases: a null text has no words and fails the base rules; a null host
is a host of its own; each row is a document, repeated rows included; lines
without a word are neither counted nor removed; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrow as A
from ._store import bound_batches, private, store

MIN_DOCS, SHARE, MIN_LEFT = 10, 0.005, 0.3
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_EXACT = A.byte_values(11)
_LINE = A.byte_values(12, lower=True, digits=True)
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,n:int>>"


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts per document; then line hash, words per line and lines per document."""
    docs = len(offsets) - 1
    inside = ~A.SPACES[data]
    starts, ends = A.bounds(inside, offsets)
    first = A.per_document(starts, offsets)
    out = {"n_words": np.diff(first)}
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    out["word_chars"] = count(inside & ((data & 0xC0) != 0x80))
    out["n_symbols"] = count(_SYMBOLS[data])

    words = A.span_hashes(_EXACT[data], starts, ends)
    found, at = A.windows(words, first, WINDOW, 5)
    doc = np.searchsorted(first, at, side="right") - 1
    with np.errstate(over="ignore"):
        key = A.mix(found + doc.astype(A.U64) * A.U64(0x9E3779B97F4A7C15))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    repeated = at[times[inverse] > 1]
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, repeated, 1)
    np.add.at(depth, repeated + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(depth)[:-1] > 0)])
    out["n_repeat_words"] = np.diff(covered[first])

    # every document has one line more than it has line feeds
    feeds = np.flatnonzero(data == 10)
    per_doc = np.diff(A.per_document(feeds, offsets)) + 1
    line_start = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    lines_first = np.concatenate([[0], np.cumsum(per_doc)])
    line_end = np.empty_like(line_start)
    line_end[:-1] = line_start[1:] - 1
    line_end[lines_first[1:] - 1] = offsets[1:]
    a, b = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    worded = b > a
    line_doc = np.repeat(np.arange(docs), per_doc)
    exact = A.span_hashes(_EXACT[data], line_start, line_end)
    with np.errstate(over="ignore"):
        key = A.mix(exact + line_doc.astype(A.U64) * A.U64(0x9E3779B97F4A7C15))[worded]
    _, earliest = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[earliest] = False
    out["n_dup_lines"] = np.bincount(line_doc[worded], weights=again, minlength=docs).astype(np.int64)
    normal = A.span_hashes(A.span_hashes(_LINE[data], starts, ends), a, b)
    return out, normal, b - a, per_doc


def _kernel(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.buffers(batch.column(0))
            for i, j in A.blocks(offsets):
                at = offsets[i : j + 1]
                counts, h, n, per_doc = _features(data[at[0] : at[-1]], at - at[0])
                lines = pa.StructArray.from_arrays([pa.array(A.signed(h), mask=n == 0), pa.array(n.astype(np.int32))], ["h", "n"])
                columns = [batch.column(1 + k).slice(i, j - i) for k in range(len(keep))]
                columns += [pa.array(counts[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                columns.append(A.lists(lines, np.concatenate([[0], np.cumsum(per_doc)])))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    return run


def line_features(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns, the base counts, and each line's hash (null without a word) and words, in order."""
    bound_batches(docs.sparkSession)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(text).cast("string"), *keep).mapInArrow(_kernel(keep), f"{fields}{', ' if fields else ''}{FEATURES}")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def boilerplate(features: DataFrame, host: str, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """One row per host that has boilerplate: the sorted hashes of its lines above the limit."""
    sizes = features.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("_docs"))
    seen = (
        features.select(F.col(host).alias("_host"), F.explode(F.array_distinct("lines.h")).alias("_h"))
        .where("_h is not null")
        .groupBy("_host", "_h")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > min_docs)
    )
    sizes = sizes.withColumnRenamed("_host", "_host2")
    above = seen.join(sizes, F.col("_host").eqNullSafe(F.col("_host2"))).where(F.col("_n") > F.col("_docs") * F.lit(share))
    return above.groupBy("_host").agg(F.sort_array(F.collect_list("_h")).alias("_bad"))


def line_frequency_filter(
    docs: DataFrame, *, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, min_left: float = MIN_LEFT, with_text: bool = True
) -> DataFrame:
    """Every row of docs with the base counts and the verdict of the line rule.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed,
    n_words_removed, base_failed, depleted and kept; columns of docs with one of these names
    are replaced. With with_text the text column holds the text without its boilerplate
    lines (null stays null); otherwise the text column is left out and no text is shuffled.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_words_removed", "base_failed", "depleted", "kept"]
    p = private(docs, *added)
    rest = [c for c in docs.columns if c != text and c.lower() not in added]
    named = docs.select(F.col(text).alias(f"{p}text"), F.col(host).alias(f"{p}host"), *[F.col(c).alias(f"{p}{i}") for i, c in enumerate(rest)])
    carried = [f"{p}host", *[f"{p}{i}" for i in range(len(rest))], *([f"{p}text"] if with_text else [])]
    if with_text:
        features = line_features(named.withColumn(f"{p}copy", F.col(f"{p}text")), f"{p}copy", carried)
        bad = boilerplate(line_features(named, f"{p}text", [f"{p}host"]), f"{p}host", min_docs, share)
    else:  # narrow rows: written once instead of computed twice
        features = store(line_features(named, f"{p}text", carried), "line-features").df
        bad = boilerplate(features, f"{p}host", min_docs, share)
    bad = store(bad, "boilerplate")
    joined = features.join(bad.side(), F.col(f"{p}host").eqNullSafe(F.col("_host")), "left")
    hit = lambda x: F.coalesce(F.array_contains(F.coalesce(F.col("_bad"), F.array().cast("array<bigint>")), x["h"]), F.lit(False))
    removed = F.filter("lines", hit)
    joined = joined.withColumns(
        {
            "n_lines_removed": F.size(removed).cast("long"),
            "n_words_removed": F.aggregate(removed, F.lit(0).cast("long"), lambda s, x: s + x["n"].cast("long")),
            "base_failed": base_failed(F.col("n_words"), F.col("n_repeat_words")),
        }
    )
    joined = joined.withColumn("depleted", (F.col("n_words") > 0) & (F.col("n_words") - F.col("n_words_removed") < F.lit(min_left) * F.col("n_words")))
    joined = joined.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    out = [F.col(f"{p}{i}").alias(c) for i, c in enumerate(rest)]
    if with_text:
        parts = F.split(F.col(f"{p}text"), "\n", -1)
        left = F.filter(F.arrays_zip(parts.alias("t"), F.col("lines").alias("l")), lambda z: ~hit(z["l"]))
        out.append(F.when(F.size(removed) > 0, F.array_join(F.transform(left, lambda z: z["t"]), "\n")).otherwise(F.col(f"{p}text")).alias(text))
    return joined.select(*out, *added)
