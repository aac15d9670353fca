"""Incremental ingestion by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shotline.sources.store import keep_latest


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files as they come."""
    return spark.readStream.schema(schema).parquet(path)


def upsert_stream(docs: DataFrame, key: str, version: str, target: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch's latest rows go to a folder of its own number, so a repeated batch overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        keep_latest(batch, key, [version]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, key: str, version: str) -> DataFrame:
    """The latest row of each key over all batches."""
    return keep_latest(spark.read.parquet(target), key, [version, "batch"]).drop("batch")


def once(docs: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Repeated keys dropped while the watermark remembers them."""
    return docs.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def counts(events: DataFrame, at: str, window: str, delay: str = "10 minutes") -> DataFrame:
    """Events per window and kind."""
    return events.withWatermark(at, delay).groupBy(F.window(at, window), "event_type").agg(F.count("*").alias("n"))
