"""Streaming ingest: events are read as files arrive, cleaned, deduplicated and appended."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T

#: How late a duplicate may come: the state of the deduplication is bounded by it.
DEDUPE_HORIZON = "7 days"
EVENT_SCHEMA = "event_id string, platform string, project string, session_id string, event_type string, ts timestamp, content string, tags array<string>, dedupe_hash string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines files as a stream; the checkpoint keeps what has been read."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def clean(events: DataFrame) -> DataFrame:
    """M1 up to the insert: blocked rows go, tags are normalised, text is redacted where a tag asks for it, types are classified, the hash is filled in."""
    tags = T.normal_tags(F.coalesce("tags", F.array().cast("array<string>")))
    rows = events.where(F.col("event_id").isNotNull() & F.col("ts").isNotNull()).withColumn("tags", tags).where(~F.arrays_overlap("tags", F.array(F.lit("block"), F.lit("no_mem"))))
    asks = F.arrays_overlap("tags", F.array(F.lit("redact"), F.lit("mask")))
    content = T.without_private_blocks(F.coalesce("content", F.lit("")))
    rows = rows.withColumn("content", F.when(asks, T.redacted(content)).otherwise(content))
    basis = F.sha2(F.concat_ws("|", "platform", "project", "session_id", "event_type", F.unix_micros("ts").cast("string"), "content"), 256)
    return rows.withColumn("dedupe_hash", F.coalesce("dedupe_hash", basis)).withColumn("observation_type", T.observation_type(F.col("content"), F.col("event_type"))).withColumn("signal", T.signal(F.col("content")))


def deduplicated(events: DataFrame, horizon: str = DEDUPE_HORIZON) -> DataFrame:
    """One row of each hash; hashes are forgotten when the watermark is past the horizon."""
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["dedupe_hash"])


def append_batch(target: str):
    """An idempotent foreachBatch: a batch is a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(target, f"batch={batch_id}"))

    return write


def run_ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Reads what is there, then stops (available-now)."""
    rows = deduplicated(clean(read_events(spark, source)))
    rows.writeStream.foreachBatch(append_batch(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Event-time windows by type, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count("*").alias("n"))
