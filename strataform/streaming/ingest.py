"""Structured Streaming over the event log: windowed counts and commits by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, name: str, files: int = 8) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}.parquet*")


def timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp with a zone; a watermark where the rows stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if events.isStreaming else rows


def window_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums by event type; rows later than ``late`` behind the newest are left out."""
    rows = timed(events, late)
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Session windows by user: (user_id, start, end, n)."""
    rows = timed(events, "1 hour")
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_timestamp("session_window.start").alias("start"), F.unix_timestamp("session_window.end").alias("end"), "n")


def run_once(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Everything there is, then stop; files and progress make each batch count once."""
    q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def commit_batches(stream: DataFrame, commit, checkpoint: str) -> None:
    """Each micro-batch as one transaction: ``commit(rows, batch_id)``."""
    q = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
