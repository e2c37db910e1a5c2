"""Sheets, benchmarks, caches and sinks with guarantees: what a run reads and leaves behind besides its tables.

Paths are opened through Spark's readers and writers and Hadoop's file systems,
so any store will do. Sinks that promise a single small file (a manifest, a
report) take bounded rows only.
"""

from __future__ import annotations

import json
import platform
import sys
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import records as R

EVIDENCE = "struct<text:string,source:string,doc_id:string,passage_id:string,score:double,metadata:map<string,string>>"
CANDIDATES = f"qid string, candidates array<{EVIDENCE}>"
#: Option columns or maps, the answer's column and its style, of the three published shapes.
SHAPES = {"letters": ("options", "answer_idx", "letter"), "columns": (["opa", "opb", "opc", "opd"], "cop", "index"), "subjects": ("options", "answer", "letter")}


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def memory(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows given in place; for fixtures."""
    return spark.createDataFrame(rows, schema)


def guard_output(path: str, protected: list[str]) -> str:
    """The path, unless it lies in a protected folder or is one of its names."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    if ".." in parts:
        raise ValueError(f"{path} leaves its folder")
    for name in protected:
        own = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
        if any(parts[i : i + len(own)] == own for i in range(len(parts))):
            raise ValueError(f"{path} is protected")
    return path


def sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An annotation sheet, one object a line; a key file is never opened."""
    if "key" in path.rsplit("/", 1)[-1].lower():
        raise ValueError(f"{path} may hold the answers")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def rewrite_sheet(df: DataFrame, changes: DataFrame, id_: str, allowed: list[str], path: str) -> DataFrame:
    """The sheet with changed cells, written whole under a new version and only then named the current one; columns outside `allowed` can't change."""
    extra = [c for c in changes.columns if c != id_ and c not in allowed]
    if extra:
        raise ValueError(f"columns {', '.join(extra)} must not change")
    spark = df.sparkSession
    new = changes.select(F.col(id_).alias("_id"), *[F.col(c).alias(f"_{c}") for c in changes.columns if c != id_])
    own = {c: F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in changes.columns if c != id_}
    merged = df.join(new, F.col(id_) == F.col("_id"), "left").withColumns(own).select(*df.columns)
    fs, folder = _at(spark, path)
    version = max((int(x.getPath().getName()[1:]) for x in fs.listStatus(folder)), default=0) + 1 if fs.exists(folder) else 1
    merged.write.mode("errorifexists").parquet(f"{path}/v{version:08d}")
    return current_sheet(spark, path)


def current_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that was written to its end; earlier versions stay as the backup."""
    fs, folder = _at(spark, path)
    done = [x.getPath().getName() for x in fs.listStatus(folder) if exists(spark, f"{path}/{x.getPath().getName()}/_SUCCESS")]
    return spark.read.parquet(f"{path}/{max(done)}")


def backup(spark: SparkSession, path: str) -> str | None:
    """An output that holds data is moved aside before it is written again; where to, or none."""
    fs, at = _at(spark, path)
    if not fs.exists(at) or fs.getContentSummary(at).getLength() == 0:
        return None
    aside = f"{path}.backup-{uuid.uuid4().hex[:12]}"
    if not fs.rename(at, _at(spark, aside)[1]):
        raise OSError(f"{path} could not be moved aside")
    return aside


def append(df: DataFrame, path: str) -> None:
    """Rows added to a growing output whose columns must stay the same."""
    spark = df.sparkSession
    if exists(spark, path) and spark.read.parquet(path).columns != df.columns:
        raise ValueError(f"{path} has other columns")
    df.write.mode("append").parquet(path)


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Each expected file (name, md5) with its state: ok, damaged or missing; files as read by binaryFile."""
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.lower("md5") == F.col("found"), "ok").otherwise("damaged")
    return expected.join(found, "name", "left").select("name", state.alias("state"))


def newest_listed(keys: DataFrame, key: str, pattern: str) -> DataFrame:
    """Of an object listing the key with the highest number for each id; the pattern captures id and number."""
    rows = keys.select(F.regexp_extract(key, pattern, 1).alias("id"), F.regexp_extract(key, pattern, 2).cast("int").alias("version"), F.col(key).alias("key")).where("id <> ''")
    return rows.groupBy("id").agg(F.max_by("key", "version").alias("key"), F.max("version").alias("version"))


def sharded(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows (shard, place, ...) of articles and vectors, one to one, with a position through all shards.

    A shard's offset is the sum of the sizes before it, from one row a shard.
    """
    from pyspark.sql import Window

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = articles.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = articles.join(vectors, ["shard", "place"], "full").join(F.broadcast(sizes), "shard", "left")
    return rows.withColumn("position", F.col("offset") + F.col("place")).drop("offset")


def npy_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of .npy matrices, with file and place."""
    import pandas as pd

    def run(batches):
        import io

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"shard": file.rsplit("/", 1)[-1].removesuffix(".npy"), "place": range(len(m)), "embedding": list(m.astype("float32"))})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInPandas(run, "shard string, place long, embedding array<float>")


def benchmark(df: DataFrame, shape: str, qid: str = "id", question: str = "question") -> DataFrame:
    """Questions of one published shape as qid, question, options (by letter) and gold."""
    options, answer, style = SHAPES[shape]
    by_letter = R.options_of_list(F.array(*options)) if isinstance(options, list) else R.options_by_letter(F.col(options))
    rows = df.withColumn("_o", by_letter)
    return rows.select(F.col(qid).cast("string").alias("qid"), F.col(question).alias("question"), F.col("_o").alias("options"), R.answer_letter(F.col(answer).cast("string"), F.col("_o"), style).alias("gold"))


def with_rows(df: DataFrame, expected: int | None) -> DataFrame:
    """The rows, refused if their number is not the published one."""
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{n} rows instead of {expected}")
    return df


def paired_texts(df: DataFrame, fields: dict[str, str], provenance: str = "", refused: str = "curated") -> tuple[DataFrame, DataFrame]:
    """Older and newer texts with their years; rows that can't be used with the reason why. fields: our name to the column's."""
    if refused in provenance.lower():
        raise ValueError(f"provenance {provenance!r} is not external")
    year = lambda c: F.nullif(F.regexp_extract(F.coalesce(F.col(c).cast("string"), F.lit("")), r"(\d{4})", 1), F.lit("")).cast("int")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rows = df.withColumns({"_older": year(fields["older_date"]), "_newer": year(fields["newer_date"])})
    reason = F.when(blank(fields["older_text"]) | blank(fields["newer_text"]), "missing text").when(F.col("_older").isNull() | F.col("_newer").isNull(), "missing or unparseable date").when(F.col("_newer") <= F.col("_older"), "newer side is not newer")
    marked = rows.withColumn("_reason", reason)
    keep = marked.where("_reason is null").select(*[F.col(c).alias(n) for n, c in fields.items()], F.col("_older").alias("older_year"), F.col("_newer").alias("newer_year"))
    return keep, marked.where("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def write_cache(df: DataFrame, path: str, fingerprint: str) -> None:
    """Candidate sets with the fingerprint of what they were made from."""
    df.write.mode("errorifexists").parquet(path)
    df.sparkSession.createDataFrame([(fingerprint,)], "fingerprint string").coalesce(1).write.mode("errorifexists").json(f"{path}.meta")


def read_cache(spark: SparkSession, path: str, fingerprint: str, allow_mismatch: bool = False) -> DataFrame:
    """The cache, refused if its sidecar is missing or names another fingerprint."""
    found = spark.read.schema("fingerprint string").json(f"{path}.meta").first()["fingerprint"] if exists(spark, f"{path}.meta") else None
    if found != fingerprint and not allow_mismatch:
        raise ValueError(f"{path} was made from {found}, not from {fingerprint}")
    return spark.read.parquet(path)


def nested(lines: DataFrame, text: str = "value") -> DataFrame:
    """Candidate sets from JSON lines; a piece of evidence that is a bare string is its text."""
    loose = F.from_json(text, "qid string, candidates array<string>")
    one = lambda x: F.when(F.ltrim(x).startswith("{"), F.from_json(x, EVIDENCE)).otherwise(F.from_json(F.to_json(F.struct(x.alias("text"))), EVIDENCE))
    return lines.select(loose.alias("r")).select("r.qid", F.transform("r.candidates", one).alias("candidates"))


def flat_json(df: DataFrame) -> DataFrame:
    """Each record as a JSON line, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def manifest(spark: SparkSession, config: dict, fingerprints: dict[str, str], command: list[str]) -> DataFrame:
    """One row that says what ran: configuration, inputs' fingerprints, versions, machine, command."""
    kept = {k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith("spark.sql.")}
    row = {"config": json.dumps(config, sort_keys=True), "fingerprints": json.dumps(fingerprints, sort_keys=True), "spark": spark.version, "python": platform.python_version(), "machine": platform.machine(), "settings": json.dumps(kept, sort_keys=True), "command": " ".join(command or sys.argv)}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


def markdown(df: DataFrame, columns: list[str], most: int) -> str:
    """A table with at most `most` rows shown and all of them counted; for aggregated frames."""
    total = df.count()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in df.select(*columns).limit(most).collect()]
    if total > most:
        lines.append(f"\n{most} of {total} rows")
    return "\n".join(lines)


class Registry:
    """Things by name; a name twice or an unknown one is an error that lists what there is."""

    def __init__(self, kind: str):
        self.kind, self._by_name = kind, {}

    def register(self, name: str) -> Callable:
        def add(thing):
            if name in self._by_name:
                raise ValueError(f"{self.kind} {name!r} is there already")
            self._by_name[name] = thing
            return thing

        return add

    def get(self, name: str):
        if name not in self._by_name:
            raise ValueError(f"unknown {self.kind} {name!r}; there are {', '.join(sorted(self._by_name))}")
        return self._by_name[name]


def endpoint(backend: str, base_url: str, key: str | None, temperature: float, refused: list[str]) -> str:
    """Q16: what forbids an answer run at this endpoint, or nothing."""
    faults = []
    if temperature != 0:
        faults.append("not greedy")
    if any(host in base_url for host in refused):
        faults.append("refused host")
    if backend != "stub" and not key:
        faults.append("no key")
    return "; ".join(faults)
