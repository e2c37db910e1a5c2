"""Session factory with the settings that the operators rely on."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, name: str = "lodestar", **conf: str) -> SparkSession:
    """AQE with skewed-join splitting, UTC, ANSI and Arrow; conf overrides any of it."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lodestar-")
    return _own[app]


#: A table below this size for each core is dealt anew if it has fewer files than there are cores.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A freshly read table, its rows dealt over all cores if its few small files would leave most of them idle.

    A file is read by as many tasks as it has row groups, and a small one has one. Larger tables and tables of many
    files come back as they are, so what is shuffled here is at most SPREAD_BYTES for each core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < cores * SPREAD_BYTES and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def ship(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package from where the driver has it.

    Enough where executors see the driver's path (local mode, a shared install);
    elsewhere the package comes with --py-files.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
