"""Scans and sinks of the file formats that the data comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestar.operators.layers import last_wins

POINTER = "version https://git-lfs"


class PointerFile(ValueError):
    """A file that is only a pointer to large-file storage."""


def guard(spark: SparkSession, path: str, columns: list[str] | None = None) -> None:
    """Refuse pointer files and files without the named columns; reads the first line only."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    if line.startswith(POINTER):
        raise PointerFile(path)
    missing = [c for c in columns or [] if c not in line.split(",")]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-string CSV with embedded line feeds and quotes, any field length, by an explicit schema."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).option("mode", "FAILFAST").csv(path)


def keyed(df: DataFrame, key: str, order: str) -> DataFrame:
    """An index by key: blank keys drop out, the last row of a key wins."""
    return last_wins(df.where(F.trim(F.coalesce(key, F.lit(""))) != ""), [key], [order])


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line, blank lines skipped, the schema given, never inferred."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def records(spark: SparkSession, path: str, element: str) -> DataFrame:
    """A JSON array, or an object that holds one under data, questions or examples."""
    whole = spark.read.text(path, wholetext=True).select("value")
    array = F.from_json("value", f"array<{element}>")
    wrapped = F.from_json("value", f"struct<data:array<{element}>,questions:array<{element}>,examples:array<{element}>>")
    is_array = F.ltrim("value").startswith("[")
    rows = whole.select(F.when(is_array, array).otherwise(F.coalesce(wrapped["data"], wrapped["questions"], wrapped["examples"])).alias("r"))
    return rows.select(F.inline("r"))


def query_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks `# Qn.m label` of a query file up to `# ===`; comment lines drop out."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^(?=# Q\d+\.\d+)")).alias("b")).where(F.col("b").rlike(r"^# Q\d+\.\d+"))
    lines = F.split(F.regexp_replace("b", r"(?ms)^# ===.*", ""), "\n")
    term = F.array_join(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: ~x.startswith("#") & (F.trim(x) != "")), " ")
    return whole.select(F.regexp_extract("b", r"^# (Q\d+\.\d+)", 1).alias("query_id"), F.trim(F.regexp_extract("b", r"^# Q\d+\.\d+[ \t]*([^\n]*)", 1)).alias("label"), F.trim(term).alias("term"))


def report_groups(spark: SparkSession, path: str) -> DataFrame:
    """`| PMC… |` ids of each `## Group:` section of a report."""
    sections = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^(?=## )")).alias("s")).where(F.col("s").startswith("## Group:"))
    ids = F.regexp_extract_all("s", F.lit(r"\| *(PMC\d+) *\|"), F.lit(1))
    return sections.select(F.trim(F.regexp_extract("s", r"^## Group:\s*([^\n]*)", 1)).alias("group"), F.explode(ids).alias("pmcid"))


def vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """A row-major float32 matrix, one record a row with its position; the length must be whole rows."""
    import numpy as np

    rows = spark.sparkContext.binaryRecords(path, dim * 4).zipWithIndex()
    return rows.map(lambda r: (r[1], np.frombuffer(r[0], "<f4").tolist())).toDF("row long, embedding array<float>")


def answers_schema(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Named fields by a mapping, all others as a metadata map."""
    rest = [c for c in df.columns if c not in mapping.values()]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    meta = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(*[F.col(v).alias(k) for k, v in mapping.items()], meta.alias("metadata"))


def write_jsonl(df: DataFrame, path: str, key: str, digest: str) -> str:
    """Rows in key order, with a one-row sidecar of their count and digest; returns the digest."""
    df.orderBy(key).write.mode("errorifexists").json(path)
    side = df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\x00", F.col(key).cast("string"), F.col(digest).cast("string")))), "\x00"), 256).alias("digest"))
    side.write.mode("errorifexists").json(f"{path}.meta")
    return side.first()["digest"]


def read_frozen(spark: SparkSession, path: str, schema: str, key: str, digest: str) -> DataFrame:
    """A frozen set, refused if its digest is not the recorded one. Frozen sets are candidate lists of bounded size."""
    df = jsonl(spark, path, schema)
    found = df.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\x00", F.col(key).cast("string"), F.col(digest).cast("string")))), "\x00"), 256).alias("d")).first()["d"]
    recorded = spark.read.schema("rows long, digest string").json(f"{path}.meta").first()["digest"]
    if found != recorded:
        raise ValueError(f"{path} is not what was frozen")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """Lists joined by `; `, nulls blank."""
    lists = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    df.select(*[F.coalesce((F.array_join(c, "; ") if c in lists else F.col(c).cast("string")), F.lit("")).alias(c) for c in df.columns]).write.option("header", True).option("escape", '"').csv(path)
