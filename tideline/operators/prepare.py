"""From messages to relative time, bounds of streams, and the dense grid of ticks.

Time stays in whole milliseconds; a tick is tick_ms long. Undefined values are null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import stripped

GRID_BLOCK = 1 << 14


def deduplicated(messages: DataFrame, *order: str) -> DataFrame:
    """The first message of each (stream_id, ts_ms, uid, text), by the order columns if given."""
    keys = ["stream_id", "ts_ms", "uid", "text"]
    if not order:
        return messages.dropDuplicates(keys)
    own = F.struct(*order)
    rest = [c for c in messages.columns if c not in keys]
    if not rest:
        return messages.dropDuplicates(keys)
    return messages.groupBy(*keys).agg(F.min_by(F.struct(*rest), own).alias("_rest")).select(*keys, "_rest.*")


def relative(messages: DataFrame, tick_ms: int = 1000, origins: DataFrame | None = None) -> DataFrame:
    """stream_id, uid, ts_ms, text, rel_ms (since the stream's origin), sec (its tick), t, length and text_norm.

    origins: stream_id and origin_ms; without it, or for a stream that it lacks, the origin is the first message.
    """
    bounds = messages.groupBy("stream_id").agg(F.min("ts_ms").alias("_first"))  # one row a stream
    if origins is not None:
        bounds = bounds.join(origins.select("stream_id", "origin_ms"), "stream_id", "left").select("stream_id", F.coalesce("origin_ms", "_first").alias("_first"))
    rel = F.col("ts_ms") - F.col("_first")
    return messages.join(bounds, "stream_id").select(
        "stream_id", "uid", "ts_ms", "text",
        rel.alias("rel_ms"), F.floor(rel / tick_ms).cast("bigint").alias("sec"), (rel / tick_ms).alias("t"),
        F.length("text").alias("length"), stripped(F.col("text")).alias("text_norm"),
    )


def bounds(rel: DataFrame) -> DataFrame:
    """One row a stream: n_total, first_ms, last_ms, dur_ms."""
    return rel.groupBy("stream_id").agg(F.count("*").alias("n_total"), F.min("rel_ms").alias("first_ms"), F.max("rel_ms").alias("last_ms"), (F.max("rel_ms") - F.min("rel_ms")).alias("dur_ms"))


def last_tick(last_ms: Column, tick_ms: int) -> Column:
    """The grid ends half a tick past the first whole tick after the last message."""
    return F.floor((2 * last_ms + (3 * tick_ms - 1)) / (2 * tick_ms)).cast("bigint")


def grid(bounds: DataFrame, tick_ms: int = 1000) -> DataFrame:
    """stream_id and tick, from 0 without gaps. Blocks of ticks are dealt out, so a long stream isn't one task's work."""
    last = last_tick(F.col("last_ms"), tick_ms)
    blocks = bounds.select("stream_id", last.alias("_last")).where("_last >= 0").select("stream_id", "_last", F.explode(F.expr(f"sequence(0L, _last div {GRID_BLOCK})")).alias("_block"))
    blocks = blocks.repartition("stream_id", "_block")
    return blocks.select("stream_id", F.explode(F.expr(f"sequence(_block * {GRID_BLOCK}, least(_last, _block * {GRID_BLOCK} + {GRID_BLOCK - 1}))")).alias("tick"))


def between(messages: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Messages within a closed interval of absolute time; the filter reaches the scan."""
    return messages.where(F.col("ts_ms").between(start_ms, end_ms))


def between_relative(messages: DataFrame, start_s: float, end_s: float) -> DataFrame:
    """Messages within a closed interval of seconds since each stream's first one."""
    first = messages.groupBy("stream_id").agg(F.min("ts_ms").alias("_first"))
    rows = messages.join(first, "stream_id")
    return rows.where(F.col("ts_ms").between(F.col("_first") + F.lit(start_s) * 1000, F.col("_first") + F.lit(end_s) * 1000)).select(messages.columns)
