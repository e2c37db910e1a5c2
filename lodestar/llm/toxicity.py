"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary texts and one
on windows of toxic texts, both by zstandard's own trainer. Texts of both classes
are alike almost everywhere, so a toxic dictionary of whole texts learns what both
share; its training windows are therefore chosen: the stretches inside words that
hold character GRAM-grams found in many toxic and, by a factor of RATIO, hardly
any ordinary texts, each as often as it occurs. What the dictionary keeps of them
is the trainer's choice.

A text is cut into windows of WINDOW words. Each is compressed with the ordinary
dictionary, and with the toxic one in front of the data as well; the difference in
length is what the toxic one saved. Savings from a threshold on are summed over
the windows and divided by a root of their number. That threshold, and where on
this sum the score passes 0.5, are calibrated on the sample: every sample text is
measured through dictionaries trained without it, each threshold gets a logistic
curve, and the one of the smallest log loss is taken.

Learning takes a documented sample: about TOXIC_ROWS and ORDINARY_ROWS labelled
rows, drawn by a hash of their id, of texts up to SAMPLE_CHARS characters; a
dictionary is trained on at most 100,000 windows of these, in shuffled order.
Every text is scored whole.

Defined cases: null and wordless texts have no windows and get the score of
such a row; labels without an id or class teach nothing; with only one class,
or none, all scores are that class's value, or 0; several labels of one
document each count.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bound_batches, private

TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_CHARS = 1000, 2000, 20_000
WINDOW, GRAM, RATIO = 8, 5, 20
SHARE, LEAST = 0.02, 4
FOLDS = 2
ORDINARY_BYTES, TOXIC_BYTES = 4096, 1536
THRESHOLDS, SPREAD = (2, 3, 4, 5, 6), 20
RIDGE = 1e-2
_MARKS = re.compile(r"[^\w\s]")


def words_of(text: str) -> list[str]:
    return _MARKS.sub("", text.lower()).split()


def windows_of(words: list[str]) -> list[bytes]:
    return [f" {' '.join(words[i : i + WINDOW])} ".encode("utf-8", "replace") for i in range(0, len(words), WINDOW)]


def _compressor(content: bytes):
    p = zstandard.ZstdCompressionParameters(
        window_log=14, chain_log=12, hash_log=13, search_log=4, min_match=GRAM, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_checksum=False, write_content_size=False, write_dict_id=False
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
    return zstandard.ZstdCompressor(dict_data=held, compression_params=p).compress


def _grams(word: str) -> Iterator[str]:
    padded = f" {word} "
    return (padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1))


def marked_windows(toxic: list[list[str]], ordinary: list[list[str]]) -> list[bytes]:
    """The stretches of words of toxic texts that hold marking grams, as often as they occur."""
    in_toxic: Counter[str] = Counter()
    for words in toxic:
        in_toxic.update({g for w in set(words) for g in _grams(w)})
    least = max(LEAST, SHARE * len(toxic))
    open_ = {g for g, n in in_toxic.items() if n >= least}
    in_ordinary: Counter[str] = Counter()
    for words in ordinary:
        in_ordinary.update({g for w in set(words) for g in _grams(w)} & open_)
    marks = {g for g in open_ if in_toxic[g] / len(toxic) >= RATIO * (in_ordinary[g] + 0.5) / max(1, len(ordinary))}
    found = []
    for words in toxic:
        for w in words:
            padded = f" {w} "
            covered = [i for i in range(len(padded) - GRAM + 1) if padded[i : i + GRAM] in marks]
            while covered:
                at = end = covered.pop(0)
                while covered and covered[0] <= end + GRAM:
                    end = covered.pop(0)
                found.append(padded[at : end + GRAM].encode("utf-8", "replace"))
    return found


def _dictionary(samples: list[bytes], size: int, k: int) -> bytes:
    random.Random(5).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples[:100_000], k=k, d=6, level=3).as_bytes()
    except zstandard.ZstdError:  # too few samples to select from
        return b"".join(samples)[:size]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int = 0
    bias: float = 0.0
    slope: float = 0.0
    constant: float | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("with_both", "with_ordinary")}  # compressors stay where they are

    def prepare(self) -> None:
        self.with_both, self.with_ordinary = _compressor(self.ordinary + self.toxic), _compressor(self.ordinary)

    def savings(self, words: list[str]) -> np.ndarray:
        """How many bytes shorter the toxic dictionary makes each window."""
        both, one = self.with_both, self.with_ordinary
        return np.array([len(one(x)) - len(both(x)) for x in windows_of(words)], np.int64)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = np.array([_excess(self.savings(words_of(t or "")), self.threshold) for t in texts], float)
        return 1 / (1 + np.exp(-(self.bias + self.slope * x)))


def _excess(saved: np.ndarray, threshold: int) -> float:
    return float(np.maximum(0, saved - threshold + 1).sum() / np.sqrt(SPREAD + len(saved)))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Log loss, bias and slope of a logistic curve, by Newton's method; both classes weigh the same, whatever the sample's shares."""
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    z, w, keep = np.c_[np.ones(len(x)), x], np.zeros(2), RIDGE * np.diag([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + keep + 1e-9 * np.eye(2), z.T @ (weight * (p - y)) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return float(-np.mean(weight * (y * np.log(p) + (1 - y) * np.log(1 - p)))), float(w[0]), float(w[1])


def _dictionaries(sides: list[list[list[str]]]) -> tuple[bytes, bytes]:
    return _dictionary([x for words in sides[0] for x in windows_of(words)], ORDINARY_BYTES, 32), _dictionary(marked_windows(sides[1], sides[0]), TOXIC_BYTES, 48)


def train(texts: list[str], toxic: list[int]) -> Model:
    """Dictionaries from all rows; the calibration sees each row through dictionaries made without it."""
    words = [words_of(t) for t in texts]
    y = np.array(toxic, int)
    if not len(y) or y.min() == y.max():
        return Model(b"", b"", constant=float(y.max()) if len(y) else 0.0)
    fold = np.arange(len(y)) % FOLDS
    sides = lambda rows: [[words[i] for i in rows if toxic[i] == k] for k in (0, 1)]
    saved: list[np.ndarray] = [np.zeros(0)] * len(y)
    for k in range(FOLDS):
        others = sides(np.flatnonzero(fold != k))
        if not all(others):
            others = sides(range(len(y)))
        part = Model(*_dictionaries(others))
        part.prepare()
        for i in np.flatnonzero(fold == k):
            saved[i] = part.savings(words[i])
    curves = {t: _curve(np.array([_excess(s, t) for s in saved]), y) for t in THRESHOLDS}
    threshold = min(curves, key=lambda t: (curves[t][0], t))
    model = Model(*_dictionaries(sides(range(len(y)))), threshold, *curves[threshold][1:])
    model.prepare()
    return model


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """Learn from the labelled rows of docs; labels holds doc_id and toxic (0 or 1)."""
    marked = labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    sizes = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    draw = F.lit(False)
    for y, most in ((0, ordinary_rows), (1, toxic_rows)):
        share = min(1.0, most / max(1, sizes.get(y, 0)))
        draw = draw | ((F.col("y") == y) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    drawn = marked.where(draw)  # at most about toxic_rows + ordinary_rows rows
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), F.col("doc") == F.col("id"))
    got = rows.where(F.length("text") <= SAMPLE_CHARS).select("doc", "y", "text").toArrow().sort_by([("doc", "ascending"), ("y", "ascending"), ("text", "ascending")])
    return train(got.column("text").to_pylist(), got.column("y").to_pylist())


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every row (default: all), score and predicted; clashing names are replaced."""
    bound_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    p = private(docs, "score", "predicted")
    names = [f"{p}{i}" for i in range(len(keep))]
    fields = "".join(f"`{n}` {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.prepare()
        for batch in batches:
            got = model.score(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    source = docs.select(F.col(text).cast("string").alias(f"{p}text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    out = source.mapInArrow(run, f"{fields}score double, predicted int")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "score", "predicted")
