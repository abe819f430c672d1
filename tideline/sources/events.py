"""Messages from the events table: one row per event, a message of its user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def messages(events: DataFrame, stream: Column | None = None) -> DataFrame:
    """stream_id, uid, ts_ms and text; one stream in all unless a column tells them apart."""
    return events.select(
        (F.lit("all") if stream is None else stream.cast("string")).alias("stream_id"),
        F.col("user_id").cast("string").alias("uid"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.when(F.col("value") < 50, F.col("event_type")).otherwise(F.concat("event_type", F.lit(" "), "props")).alias("text"),
    )


def read(spark: SparkSession, sf_dir: str, by_day: bool = False) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return messages(events, F.to_date(F.col("ts").cast("timestamp")) if by_day else None)
