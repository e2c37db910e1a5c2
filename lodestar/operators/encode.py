"""any model over texts in Arrow batches: bucketed by length, halved on failure, windows pooled in the same pass.

load() runs once for each Python worker and returns a function from a list of
token lists to a list of numbers, or of lists of numbers. Texts of one Arrow
batch are sorted by length, so those that share a call are about as long, and a
call has at most `most` tokens with its padding. A call that fails is cut in two
until the text that it fails on stands alone; that text becomes a row with its
error, and all others are scored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[list[str]]], list]
WORDS = re.compile(r"[^ \t\n\x0b\f\r]+")


def calls(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of texts for one call each: of about one length, longest last, padded size at most `most`; a longer text goes alone."""
    order = np.argsort(sizes, kind="stable")
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and max(1, sizes[order[end]]) * (end + 1 - start) <= most:
            end += 1
        yield order[start:end]
        start = end


def scored(model: Model, texts: list[list[str]], most: int) -> tuple[list, list[str | None]]:
    """The model's value of each text, or its error."""
    values: list = [None] * len(texts)
    errors: list[str | None] = [None] * len(texts)
    waiting = list(calls(np.array([len(t) for t in texts], np.int64), most))[::-1]
    while waiting:
        at = waiting.pop()
        try:
            found = model([texts[i] for i in at])
            if len(found) != len(at):
                raise ValueError(f"{len(found)} values for {len(at)} texts")
        except Exception as e:  # noqa: BLE001  any failure of the model: smaller calls, then a row of its own
            if len(at) == 1:
                errors[at[0]] = f"{type(e).__name__}: {e}"
            else:
                waiting += [at[len(at) // 2 :], at[: len(at) // 2]]
            continue
        for i, v in zip(at, found, strict=True):
            values[i] = v
    return values, errors


def _source(df: DataFrame, id_: str, text: str) -> DataFrame:
    return df.select(F.col(id_).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))


def encode(df: DataFrame, id_: str, text: str, load: Callable[[], Model], kind: str = "double", most: int = 4096) -> DataFrame:
    """id, value (of the Spark type `kind`) and error of every row."""
    into = {"double": pa.float64(), "array<double>": pa.list_(pa.float64())}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            values, errors = scored(model, [WORDS.findall(t) for t in batch.column(1).to_pylist()], most)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, into), pa.array(errors, pa.string())], names=["id", "value", "error"])

    out = _source(df, id_, text).mapInArrow(run, f"id {df.schema[id_].dataType.simpleString()}, value {kind}, error string")
    return out.withColumnRenamed("id", id_)


def window_starts(size: int, width: int, overlap: int) -> list[int]:
    """Starts of windows of `width` tokens that share `overlap` with the one before; the last reaches the end."""
    step = width - overlap
    return list(range(0, max(0, -(-(size - width) // step)) * step + 1, step))


def strided(df: DataFrame, id_: str, text: str, load: Callable[[], Model], width: int, overlap: int, most: int = 4096) -> DataFrame:
    """id, the largest value over a text's overlapping windows, how many there are, and the first error.

    Windows are made, scored and pooled inside the Arrow batch: nothing is exploded or grouped again. A text with a
    window that fails has no value.
    """
    if not 0 <= overlap < width:
        raise ValueError("windows must move on")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            windows, first = [], []
            for t in batch.column(1).to_pylist():
                words = WORDS.findall(t)
                first.append(len(windows))
                windows += [words[s : s + width] for s in window_starts(len(words), width, overlap)]
            values, errors = scored(model, windows, most)
            if not first:
                continue
            of = np.array([np.nan if v is None else v for v in values], np.float64)
            best = np.maximum.reduceat(of, first)  # a nan stays, so a failed window leaves no value
            ends = [*first[1:], len(windows)]
            why = [next((e for e in errors[a:b] if e), None) for a, b in zip(first, ends, strict=True)]
            columns = [batch.column(0), pa.array(best, mask=np.isnan(best)), pa.array(np.diff([*first, len(windows)]).astype(np.int64)), pa.array(why, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "value", "windows", "error"])

    out = _source(df, id_, text).mapInArrow(run, f"id {df.schema[id_].dataType.simpleString()}, value double, windows long, error string")
    return out.withColumnRenamed("id", id_)
