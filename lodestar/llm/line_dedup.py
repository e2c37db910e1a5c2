"""Line dedup: lines found in many documents lose all their places.

Texts are split at \\n. A line's key is the line without the white space
``[\\x20\\x09-\\x0D]`` at both ends, A-Z folded; it is named by the 128 bits of its
MD5. Names are exploded once per document, counted (partial sums before the
shuffle, so a line that every document has is one row of each task), and those
of at least ``min_docs`` documents are joined back to the exploded places of
lines. A text's dropped places meet under the MD5 of the text, which needs no
row number and lets equal texts share one answer; what lies between two dropped
places is a slice of the text's lines, so a text is put together again in
time linear in its lines. Texts are moved by one join on their names, which
AQE splits where one text has very many copies, and not at all while the table
of dropped places is small enough to be broadcast.

DataFrame functions only.

Defined cases: a null or empty text is one empty line; keys of fewer than
``min_chars`` code points are never dropped; each row is a document, repeated
rows and repeated or null ids included; a text that loses all lines is empty;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import private, store

MIN_DOCS, MIN_CHARS = 10, 1
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A character that lower() might change though it is none of A-Z; without one, lower() folds A-Z only and is much faster than translate().
BEYOND = "[^\\x00-\\x7F\\u00DF-\\u00FF\\u2010-\\u2027]"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z folded and nothing else."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(bare.rlike(BEYOND), F.translate(bare, UPPER, LOWER)).otherwise(F.lower(bare))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _name(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _without(text: Column, cut: Column) -> Column:
    """The lines between the sorted places in cut, joined again."""
    starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda c: c + 1))
    # the one-element array binds the lines to a variable, so that they are split once and not once for each slice
    kept = F.transform(
        F.array(_lines(text)),
        lambda lines: F.array_join(F.flatten(F.zip_with(starts, F.concat(cut, F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 1, b - a))), "\n"),
    )
    return kept[0]


def frequent_lines(docs: DataFrame, *, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """Names of texts with the names of their lines in order (null: too short), and the names of lines to drop."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def name(line: Column) -> Column:
        return F.transform(F.array(line_key(line)), lambda k: F.when(F.length(k) >= min_chars, F.md5(k)))[0]

    named = store(docs.select(_name(whole).alias("th"), F.transform(_lines(whole), name).alias("names")), "line-names")
    seen = named.df.select(F.explode(F.array_distinct("names")).alias("h")).where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("docs"))
    return named.df, seen.where(F.col("docs") >= min_docs).select("h")


def line_dedup(docs: DataFrame, *, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep: list[str] | None = None) -> DataFrame:
    """For every row: the kept columns, n_lines, n_dropped and kept (the text that is left).

    keep: columns of docs to carry (default: all); of these, ones named like an added column are left out.
    """
    added = ["n_lines", "n_dropped", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    p = private(docs, *added)
    named, frequent = frequent_lines(docs, text=text, min_docs=min_docs, min_chars=min_chars)
    frequent = store(frequent, "line-frequent")
    places = named.select("th", F.posexplode("names").alias("pos", "h")).where("h is not null").join(frequent.side(), "h", "left_semi")
    cut = store(places.groupBy("th").agg(F.array_sort(F.collect_set("pos")).alias("cut")).select(F.col("th").alias(f"{p}th"), F.col("cut").alias(f"{p}cut")), "line-places")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(whole.alias(f"{p}text"), _name(whole).alias(f"{p}th"), *[F.col(c).alias(f"{p}{i}") for i, c in enumerate(keep)])
    joined = source.join(cut.side(), f"{p}th", "left")
    t, gone = F.col(f"{p}text"), F.col(f"{p}cut")
    return joined.select(
        *[F.col(f"{p}{i}").alias(c) for i, c in enumerate(keep)],
        F.size(_lines(t)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(gone.isNull(), t).otherwise(_without(t, gone)).alias("kept"),
    )
