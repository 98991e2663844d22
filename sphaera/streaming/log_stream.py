"""Iteration logs as streams: state across batches, re-runs and late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import exists, work_path


def read_events(spark: SparkSession, path: str, schema, max_files: int = 1, names: str | None = None) -> DataFrame:
    """New Parquet files of a folder, those that match names only."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return (reader.option("pathGlobFilter", names) if names else reader).parquet(path)


def score_summary(events: DataFrame, watermark: str = "1 day", window: str = "1 day") -> DataFrame:
    """Per window and configuration: iterations, mean and largest score; windows close when the watermark passes."""
    good = events.filter(F.col("value").isNotNull() & ~F.isnan("value")).withWatermark("ts", watermark)
    return good.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_score"), F.max("value").alias("best_score"))


def best_so_far(events: DataFrame) -> DataFrame:
    """Per configuration, over all batches: iterations and the best score (complete or update mode)."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("best_score"))


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs what is there through to a table in the shared folder: the last state (complete) or all rows that were closed (append).

    Each batch has a folder of its own, so a batch that runs again after a failure replaces itself.
    """
    if mode not in ("complete", "append"):
        raise ValueError("mode must be complete or append")
    spark = stream.sparkSession
    path = work_path(spark, f"stream-{name}")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    if not exists(spark, f"{path}/batch=*"):
        return spark.createDataFrame([], stream.schema)
    found = spark.read.option("recursiveFileLookup", "true").schema(stream.schema).parquet(path) if mode == "append" else None
    if found is None:
        last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
        found = spark.createDataFrame([], stream.schema) if last is None else spark.read.schema(stream.schema).parquet(f"{path}/batch={int(last):012d}")
    return found
