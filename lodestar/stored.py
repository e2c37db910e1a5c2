"""Tables that are written once in the folder that all executors share, and read from there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from lodestar.session import shared_dir


def write_once(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table under spark.checkpoint.dir: nothing above it is computed again, whatever executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/lodestar/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
