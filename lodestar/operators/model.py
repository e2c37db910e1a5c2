"""The one seam for models: a scorer of texts behind a pandas UDF, with deterministic stubs in built-in functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stub_probability(*parts: Column) -> Column:
    """A number in [0, 1) from the hash of the texts; stands for any model that is not there."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def stub_vector(text: Column, dim: int = 8) -> Column:
    """A unit vector from the hash of a text, `dim` up to 32."""
    h = F.sha2(text, 256)
    raw = F.array(*[F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("double") / 127.5 - 1 for i in range(dim)])
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / norm(raw))


def stub_choice(prompt: Column, letters: str = "ABCD") -> Column:
    """A letter by hash."""
    return F.element_at(F.array(*map(F.lit, letters)), (F.floor(stub_probability(prompt) * len(letters)) + 1).cast("int"))


#: Generators by name: a prompt column to a text column. Others register a pandas UDF made like scorer's.
BACKENDS: dict[str, Callable[[Column], Column]] = {"stub": lambda prompt: F.concat(F.lit("The answer is ("), stub_choice(prompt), F.lit(")."))}


def generate(backend: str, prompt: Column) -> Column:
    """the text that a backend generates for each prompt; an unknown name is an error that lists what there is."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}; there are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[backend](prompt)


def scorer(load: Callable[[], Callable[[list[str]], list[float]]]):
    """load() runs once per Python worker, its result scores one batch of texts at a time."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.fillna("").tolist()), dtype="float64")

    return score


def score_once(pairs: DataFrame, keys: list[str], text: Column, model: Callable[[Column], Column]) -> DataFrame:
    """Each distinct text is scored once and joined back by its digest."""
    named = pairs.withColumn("_text", text).withColumn("_sha", F.sha2("_text", 256))
    scores = named.groupBy("_sha").agg(F.any_value("_text").alias("_text")).select("_sha", model(F.col("_text")).alias("p"))
    return named.drop("_text").join(scores, "_sha").drop("_sha")


def decide(pairs: DataFrame, probability: str, threshold: float = 0.5) -> DataFrame:
    """One decision for every row, in no other order or number than they came."""
    return pairs.withColumn("keep", F.col(probability) >= threshold).withColumn("label", F.when(F.col("keep"), "HELPFUL").otherwise("NOT_HELPFUL"))


def captured(run: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """an opaque arm for applyInPandas whose failure becomes a row with its error instead of a lost question."""

    def safe(group: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(group).assign(error=None)
        except Exception as e:  # recorded, not dropped
            return pd.DataFrame([dict.fromkeys(columns) | {columns[0]: group[columns[0]].iloc[0], "error": f"{type(e).__name__}: {e}"}])

    return safe
