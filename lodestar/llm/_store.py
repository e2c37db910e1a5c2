"""Intermediate tables in the folder that all executors share, and joins whose broadcast is checked by size."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only up to this size on disk and this number of rows.
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 1_500_000

#: Rows in an Arrow batch of texts: a worker holds one batch at a time, so its memory follows this and the longest text.
TEXT_ROWS = 500

_own: dict[str, str] = {}


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to TEXT_ROWS rows, if they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lodestar-")
    return _own[app]


@dataclass
class Stored:
    df: DataFrame
    path: str
    bytes: int
    rows: int

    def small(self) -> bool:
        return self.bytes <= BROADCAST_BYTES and self.rows <= BROADCAST_ROWS

    def side(self) -> DataFrame:
        """For the right side of a join: broadcast while its size is small, else left to the planner's shuffle join."""
        return F.broadcast(self.df) if self.small() else self.df

    def drop(self) -> None:
        _delete(self.df.sparkSession, self.path)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> Stored:
    """Write the rows once as Parquet in the shared folder and read them from there.

    The files survive the loss of any executor, and nothing above is computed again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    fs, at = _hadoop(spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    return Stored(back, path, fs.getContentSummary(at).getLength(), back.count())


def private(df: DataFrame, *wanted: str, prefix: str = "_ls_") -> str:
    """A prefix for helper columns that clashes with no column of df."""
    names = [c.lower() for c in (*df.columns, *wanted)]
    while any(c.startswith(prefix) for c in names):
        prefix = "_" + prefix
    return prefix
