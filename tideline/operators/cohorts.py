"""Who speaks in an interval: users that come for it alone, stay, are won over, or return after a silence.

Offsets are whole numbers of quarter milliseconds, so comparisons are exact; each is at most a quarter of the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.detect import exploded


def offset4(seconds: float, tick_ms: int, dur_ms: Column) -> Column:
    """Four times an offset in milliseconds: seconds (ticks), or a quarter of the stream if that is less."""
    return F.least(F.lit(int(seconds * tick_ms * 4)), dur_ms)


def interval_users(rel: DataFrame, intervals: DataFrame, tick_ms: int) -> DataFrame:
    """Users of each closed interval: stream_id, t_start, t_end, cand_id, uid. Equal ticks are joined, then times compared."""
    spoken = exploded(intervals, "cand_id").withColumnRenamed("tick", "sec").join(rel.select("stream_id", "sec", "uid", "rel_ms"), ["stream_id", "sec"])
    return spoken.where(F.col("rel_ms") <= F.col("t_end") * tick_ms).select("stream_id", "cand_id", "t_start", "t_end", "uid").distinct()


def lifecycle(rel: DataFrame, bounds: DataFrame, intervals: DataFrame, tick_ms: int = 1000) -> DataFrame:
    """Per interval: instant (never speak outside), else persistent (long before and long after), else converted
    (began shortly before or in it, and stayed) users, all users, and the three offsets in ticks."""
    seen = rel.groupBy("stream_id", "uid").agg(F.min("rel_ms").alias("first"), F.max("rel_ms").alias("last"))
    out = interval_users(rel, intervals, tick_ms).join(seen, ["stream_id", "uid"]).join(bounds.select("stream_id", "dur_ms"), "stream_id")
    a, b, c = (offset4(s, tick_ms, F.col("dur_ms")) for s in (300, 120, 600))
    start, end, first, last = (4 * x for x in (F.col("t_start") * tick_ms, F.col("t_end") * tick_ms, F.col("first"), F.col("last")))
    instant = (first >= start) & (last <= end)
    persistent = (first < start - a) & (last > end + a)
    converted = (first >= start - b) & (first <= end) & (last > end + c)
    kind = F.when(instant, "instant").when(persistent, "persistent").when(converted, "converted")
    counted = out.withColumn("_kind", kind).groupBy("stream_id", "cand_id").agg(
        F.count_if(F.col("_kind") == "instant").alias("instant"), F.count_if(F.col("_kind") == "persistent").alias("persistent"), F.count_if(F.col("_kind") == "converted").alias("converted"), F.count("*").alias("total_users")
    )
    full = intervals.select("stream_id", "cand_id", "t_start", "t_end").join(bounds.select("stream_id", "dur_ms"), "stream_id").join(counted, ["stream_id", "cand_id"], "left")
    return full.select(
        "stream_id", "cand_id", "t_start", "t_end", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("instant", "persistent", "converted", "total_users")],
        *[(offset4(s, tick_ms, F.col("dur_ms")) / (4 * tick_ms)).alias(f"offset_{n}") for n, s in (("a", 300), ("b", 120), ("c", 600))],
    )


def returning(rel: DataFrame, bounds: DataFrame, intervals: DataFrame, tick_ms: int = 1000) -> DataFrame:
    """Per interval: users that spoke before a gap ahead of it and not within the gap, and their share.

    A message lies in the gap if its time is in [t_start - off(1200), t_start - off(120)). Whether a user spoke before
    is told by the first message; who spoke within, by a join of equal ticks, as for the interval itself.
    """
    far, near = (4 * F.col("t_start") * tick_ms - offset4(s, tick_ms, F.col("dur_ms")) for s in (1200, 120))
    spans = intervals.select("stream_id", "cand_id", "t_start", "t_end").join(bounds.select("stream_id", "dur_ms"), "stream_id").withColumn("_far", far).withColumn("_near", near)
    seen = rel.groupBy("stream_id", "uid").agg((4 * F.min("rel_ms")).alias("_first"))
    users = interval_users(rel, intervals, tick_ms).join(spans.select("stream_id", "cand_id", "_far"), ["stream_id", "cand_id"]).join(seen, ["stream_id", "uid"])
    ticks = F.sequence(F.floor(F.col("_far") / (4 * tick_ms)), F.floor((F.col("_near") - 1) / (4 * tick_ms)))
    gap = spans.where("_far < _near").select("stream_id", "cand_id", "_far", "_near", F.explode(ticks).alias("sec"))
    at = 4 * F.col("rel_ms")
    within = gap.join(rel.select("stream_id", "sec", "uid", "rel_ms"), ["stream_id", "sec"]).where((at >= F.col("_far")) & (at < F.col("_near"))).select("stream_id", "cand_id", "uid").distinct()
    judged = users.join(within.withColumn("_within", F.lit(True)), ["stream_id", "cand_id", "uid"], "left")
    counted = judged.groupBy("stream_id", "cand_id").agg(F.count_if((F.col("_first") < F.col("_far")) & F.col("_within").isNull()).alias("returning_count"), F.count("*").alias("total_users"))
    full = spans.join(counted, ["stream_id", "cand_id"], "left")
    return full.select(
        "stream_id", "cand_id", "t_start", "t_end", F.coalesce("returning_count", F.lit(0)).alias("returning_count"), F.coalesce("total_users", F.lit(0)).alias("total_users"),
        (F.col("returning_count") / F.when(F.col("total_users") > 0, F.col("total_users"))).alias("ratio"), (F.col("_far") / (4 * tick_ms)).alias("gap_start"), (F.col("_near") / (4 * tick_ms)).alias("gap_end"),
    )
