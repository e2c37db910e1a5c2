"""Incremental ingest with Structured Streaming; every stream commits to files under a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _source(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    is_file = path.endswith(".parquet") and not _is_folder(spark, path)
    folder, name = path.rsplit("/", 1)
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def drain(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, then read what it committed."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")


def tumbling_counts(spark: SparkSession, path: str, out: str, window: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; each batch's partial sums are appended, so windows still open are counted too."""

    def commit(batch: DataFrame, epoch: int) -> None:
        # one folder per epoch: a replayed epoch overwrites itself
        part = batch.groupBy(F.window("ts", window)["start"].alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        part.write.mode("overwrite").parquet(f"{out}/data/epoch={epoch}")

    stream = _source(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.schema("bucket timestamp, event_type string, n long, total double").option("recursiveFileLookup", True).parquet(f"{out}/data")
    return parts.groupBy("bucket", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 6).alias("total"))


def deduplicated(spark: SparkSession, path: str, out: str, key: str = "event_id") -> DataFrame:
    """Rows whose key came first; the state holds keys, not rows."""
    return drain(_source(spark, path).dropDuplicates([key]), out)
