"""Structured Streaming over the event log: windowed latencies, a daily request log, a running budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def summarise(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts, sums and maxima by event type and tumbling window; the same plan for tables and streams."""
    return events.groupBy("event_type", F.window("ts", width)).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("slowest"))


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def latency_windows(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Windows that close when the watermark has passed them; later rows are dropped."""
    return summarise(events.withWatermark("ts", lateness), width)


def write_request_log(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends each request as a JSON line under its UTC day, exactly once."""
    lines = events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.to_json(F.struct("event_id", "ts", "event_type", "value")).alias("value"))
    return lines.writeStream.format("text").partitionBy("day").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_budget(events: DataFrame, cap: float) -> DataFrame:
    """Spend so far of every phase and whether it is within the cap (a stateful aggregate)."""
    return events.groupBy("event_type").agg(F.sum(F.col("value") / 1000).alias("spent")).withColumn("within", F.col("spent") <= cap)
