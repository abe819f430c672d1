"""Causal indicators over a stream of messages: what needs no later message, with watermarks for late ones.

Windows are Spark's, labelled by their end, so that a row at tick t covers [t - W, t); windows without messages
don't appear, and the first ones are partial. Activation needs the future of a stream and has no form here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import stripped
from tideline.params import Windows


def timed(messages: DataFrame, watermark: str = "30 seconds") -> DataFrame:
    """messages (stream_id, uid, ts_ms, text) with event_time and a watermark."""
    return messages.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", watermark)


def without_repeats(timed: DataFrame) -> DataFrame:
    """The first of equal messages within the watermark."""
    return timed.dropDuplicatesWithinWatermark(["stream_id", "ts_ms", "uid", "text"])


def _by_window(timed: DataFrame, w: Windows, *more):
    length = f"{w.window * w.tick_ms} milliseconds"
    return timed.groupBy("stream_id", F.window("event_time", length, f"{w.tick_ms} milliseconds"), *more)


def density_and_length(timed: DataFrame, w: Windows = Windows()) -> DataFrame:
    """end_ms, d, short_ratio and long_ratio of each window with messages."""
    n = F.length("text")
    out = _by_window(timed, w).agg(F.count("*").alias("d"), F.count_if(n <= w.short_most).alias("_s"), F.count_if(n > w.long_over).alias("_l"))
    return out.select("stream_id", F.unix_millis("window.end").alias("end_ms"), "d", (F.col("_s") / F.col("d")).alias("short_ratio"), (F.col("_l") / F.col("d")).alias("long_ratio"))


def repeats(timed: DataFrame, w: Windows = Windows()) -> DataFrame:
    """end_ms, text and count of each text in each window: what the repeat ratio is made of."""
    out = _by_window(timed.withColumn("text_norm", stripped(F.col("text"))), w, "text_norm").agg(F.count("*").alias("c"))
    return out.select("stream_id", F.unix_millis("window.end").alias("end_ms"), "text_norm", "c")


def repeat_ratio(timed: DataFrame, w: Windows = Windows(), min_repeats: int = 3) -> DataFrame:
    """end_ms and repeat_ratio of each window with messages, by two chained aggregations of the same windows."""
    k = max(2, min_repeats)
    per_text = _by_window(timed.withColumn("text_norm", stripped(F.col("text"))), w, "text_norm").agg(F.count("*").alias("c"))
    out = per_text.groupBy("stream_id", "window").agg(F.sum(F.when(F.col("c") >= k, F.col("c")).otherwise(0)).alias("_r"), F.sum("c").alias("_n"))
    return out.select("stream_id", F.unix_millis("window.end").alias("end_ms"), (F.col("_r") / F.col("_n")).alias("repeat_ratio"))


def concentration(timed: DataFrame, w: Windows = Windows(), top: int = 3) -> DataFrame:
    """end_ms and concentration (share of the busiest users) of each window with messages."""
    per_user = _by_window(timed, w, "uid").agg(F.count("*").alias("c"))
    kinds = per_user.groupBy("stream_id", "window", "c").agg(F.count("*").alias("k"))
    out = kinds.groupBy("stream_id", "window").agg(F.sort_array(F.collect_list(F.struct("c", "k")), asc=False).alias("_r"), F.sum(F.col("c") * F.col("k")).alias("_n"))
    start = F.struct(F.lit(top).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("sum"))
    best = F.aggregate(F.slice("_r", 1, top), start, lambda a, x: F.struct((a["left"] - F.least(a["left"], x["k"])).alias("left"), (a["sum"] + F.least(a["left"], x["k"]) * x["c"]).alias("sum")), lambda a: a["sum"])
    return out.select("stream_id", F.unix_millis("window.end").alias("end_ms"), (best / F.col("_n")).alias("concentration"))
