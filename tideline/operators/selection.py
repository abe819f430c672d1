"""What there is to choose from: platforms, their streamers, those's sessions and their chunks, each in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.prepare import between_relative


def platforms(sessions: DataFrame) -> DataFrame:
    return sessions.select("platform").distinct().orderBy("platform")


def streamers(sessions: DataFrame, platform: str) -> DataFrame:
    return sessions.where(F.col("platform") == platform).select("user_name").distinct().orderBy("user_name")


def sessions_of(sessions: DataFrame, platform: str, user_name: str) -> DataFrame:
    """The latest session last."""
    return sessions.where((F.col("platform") == platform) & (F.col("user_name") == user_name)).orderBy("start_ms", "label")


def chunks_of(sessions: DataFrame, platform: str, user_name: str, start_ms: int) -> DataFrame:
    """chunk (from 0), path, created_ms and modified_ms of one session."""
    own = sessions.where((F.col("platform") == platform) & (F.col("user_name") == user_name) & (F.col("start_ms") == start_ms))
    return own.select(F.posexplode("chunks").alias("chunk", "c")).select("chunk", "c.path", "c.created_ms", "c.modified_ms").orderBy("chunk")


def choices(sessions: DataFrame) -> DataFrame:
    """One row for each platform and streamer: how many sessions and chunks can be chosen, and the first and last start."""
    return sessions.groupBy("platform", "user_name").agg(F.count("*").alias("n_sessions"), F.sum("n_chunks").alias("n_chunks"), F.min("start_ms").alias("first_start_ms"), F.max("start_ms").alias("last_start_ms"))


def preview_counts(messages: DataFrame, start_s: float, end_s: float) -> DataFrame:
    """stream_id and n: messages that a closed interval of seconds since the stream's first one would keep."""
    kept = between_relative(messages, start_s, end_s).groupBy("stream_id").agg(F.count("*").alias("n"))
    return messages.select("stream_id").distinct().join(kept, "stream_id", "left").select("stream_id", F.coalesce("n", F.lit(0)).alias("n"))
