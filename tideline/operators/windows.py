"""Sliding indicators on the dense grid: trailing windows [t - W, t), one value a tick.

A window is computed by scattering: what a second holds is aggregated first, then added to each of the W ticks that
see it, and aggregated by tick. All of it is hash aggregation that combines before its shuffle, so one long stream
spreads over all tasks, where a window function would sort it in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.prepare import GRID_BLOCK
from tideline.params import DetectionParams, Windows


def scattered(rows: DataFrame, window: int, shift: int = 0) -> DataFrame:
    """rows with sec, once for each tick whose window [tick - window - shift, tick - shift) holds that second."""
    return rows.withColumn("tick", F.explode(F.sequence(F.col("sec") + (1 + shift), F.col("sec") + (window + shift))))


def defined_from(tick: Column, first: int, value: Column) -> Column:
    return F.when(tick >= first, value)


def rolling_sum(per_second: DataFrame, grid: DataFrame, window: int, *columns: str) -> DataFrame:
    """Sums over [t - window, t) of columns of rows by (stream_id, sec); null for the first window ticks, 0 without rows."""
    sums = scattered(per_second, window).groupBy("stream_id", "tick").agg(*[F.sum(c).alias(c) for c in columns])
    out = grid.join(sums, ["stream_id", "tick"], "left")
    return out.select("stream_id", "tick", *[defined_from(F.col("tick"), window, F.coalesce(c, F.lit(0))).alias(c) for c in columns])


def counts(rel: DataFrame, grid: DataFrame, w: Windows = Windows()) -> DataFrame:
    """Message counts of each window: d in all, d_short and d_long of them."""
    per_second = rel.where("sec >= 0").groupBy("stream_id", "sec").agg(
        F.count("*").alias("d"), F.count_if(F.col("length") <= w.short_most).alias("d_short"), F.count_if(F.col("length") > w.long_over).alias("d_long")
    )
    return rolling_sum(per_second, grid, w.window, "d", "d_short", "d_long")


def density(rel: DataFrame, grid: DataFrame, w: Windows = Windows()) -> DataFrame:
    return counts(rel, grid, w).select("stream_id", "tick", "d")


def burst(density: DataFrame, block: int = GRID_BLOCK) -> DataFrame:
    """Rate of change of the density smoothed over three ticks, and its ratio to the tick before.

    Windows run over blocks of ticks that repeat what their first and last ticks see of the neighbours, so that a
    long stream is dealt out.
    """
    homes = [F.floor((F.col("tick") + shift) / block) for shift in (0, 1, 2, -1)]
    rows = density.withColumn("_block", F.explode(F.array_distinct(F.array(*homes))))
    by = Window.partitionBy("stream_id", "_block").orderBy("tick")
    three = by.rowsBetween(-1, 1)
    smooth = F.sum("d").over(three) / F.count("d").over(three)
    out = rows.withColumn("_smooth", smooth).withColumn("_before", F.lag("d").over(by)).withColumn("s", F.col("_smooth") - F.lag("_smooth").over(by))
    return out.where(F.col("_block") == homes[0]).select("stream_id", "tick", "d", "s", (F.col("d") / F.greatest(F.coalesce("_before", F.lit(1)), F.lit(1))).alias("s_rel"))


def length_mix(counts: DataFrame) -> DataFrame:
    """Shares of short, middling and long messages; null without messages in the window."""
    whole = F.when(F.col("d") > 0, F.col("d"))
    short, long = F.col("d_short") / whole, F.col("d_long") / whole
    return counts.select("stream_id", "tick", short.alias("short_ratio"), (1 - short - long).alias("mid_ratio"), long.alias("long_ratio"))


def observation_quarter_ms(dur_ms: Column, w: Windows) -> Column:
    """Four times the observation period in milliseconds, a whole number."""
    return F.least(F.lit(int(w.observation * w.tick_ms * 4)), F.floor(dur_ms * (4 * w.observation_ratio)).cast("bigint"))


def user_pool(rel: DataFrame, bounds: DataFrame, w: Windows = Windows()) -> DataFrame:
    """stream_id, uid and is_silent of users with messages after the observation period: few of them, or more."""
    obs = bounds.select("stream_id", observation_quarter_ms(F.col("dur_ms"), w).alias("obs4"))
    late = rel.join(obs, "stream_id").where(4 * F.col("rel_ms") >= F.col("obs4"))
    return late.groupBy("stream_id", "uid").agg(F.count("*").alias("n")).select("stream_id", "uid", (F.col("n") <= w.silent_most).alias("is_silent"))


def user_ticks(rel: DataFrame, window: int) -> DataFrame:
    """stream_id, tick, uid and c: a user's messages within each window that has any."""
    per_second = rel.groupBy("stream_id", "sec", "uid").agg(F.count("*").alias("c"))
    return scattered(per_second, window).groupBy("stream_id", "tick", "uid").agg(F.sum("c").alias("c"))


def audience(rel: DataFrame, bounds: DataFrame, grid: DataFrame, w: Windows = Windows()) -> DataFrame:
    """activation (share of a window's users that are silent otherwise) and concentration (share of its three busiest users).

    The busiest are found from how many users have each count, so no window's users ever meet in one list.
    """
    pool = user_pool(rel, bounds, w).where("is_silent").select("stream_id", "uid", F.lit(1).alias("_silent"))
    kinds = (
        user_ticks(rel, w.window)
        .join(pool, ["stream_id", "uid"], "left")
        .groupBy("stream_id", "tick", "c")
        .agg(F.count("*").alias("k"), F.count("_silent").alias("silent"))
    )
    ranked = F.sort_array(F.collect_list(F.struct("c", "k")), asc=False)
    per_tick = kinds.groupBy("stream_id", "tick").agg(F.sum("k").alias("n_users"), F.sum("silent").alias("n_silent"), F.sum(F.col("c") * F.col("k")).alias("n_messages"), ranked.alias("_ranked"))
    start = F.struct(F.lit(3).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("sum"))
    top = F.aggregate(
        F.slice("_ranked", 1, 3), start, lambda a, x: F.struct((a["left"] - F.least(a["left"], x["k"])).alias("left"), (a["sum"] + F.least(a["left"], x["k"]) * x["c"]).alias("sum")), lambda a: a["sum"]
    )
    obs = bounds.select("stream_id", observation_quarter_ms(F.col("dur_ms"), w).alias("obs4"))
    out = grid.join(per_tick.withColumn("top3", top).drop("_ranked"), ["stream_id", "tick"], "left").join(obs, "stream_id")
    seen = 4 * w.tick_ms * F.col("tick") >= F.col("obs4")
    return out.select(
        "stream_id", "tick",
        F.when(seen, F.col("n_silent")).alias("n_silent"), F.when(seen, F.col("n_users")).alias("n_users"),
        F.when(seen, F.col("n_silent") / F.col("n_users")).alias("activation"),
        defined_from(F.col("tick"), w.window, F.col("top3")).alias("top3"),
        defined_from(F.col("tick"), w.window, F.col("top3") / F.col("n_messages")).alias("concentration"),
    )


def presence(rel: DataFrame, reach: int) -> DataFrame:
    """stream_id, uid, a and b of each run of a user's seconds no more than reach apart, and before, the end of the run before."""
    seconds = rel.where("sec >= 0").select("stream_id", "uid", "sec").distinct()
    by = Window.partitionBy("stream_id", "uid").orderBy("sec")
    opens = F.when(F.col("sec") - F.lag("sec").over(by) <= reach, 0).otherwise(1)
    numbered = seconds.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("stream_id", "uid", "_run").agg(F.min("sec").alias("a"), F.max("sec").alias("b"))
    return runs.select("stream_id", "uid", "a", "b", F.lag("b").over(Window.partitionBy("stream_id", "uid").orderBy("_run")).alias("before"))


def accumulated(changes: DataFrame, grid: DataFrame, *columns: str, block: int = GRID_BLOCK) -> DataFrame:
    """Running sums over the grid of changes by (stream_id, tick). Sums run within blocks, on what the blocks before add up to."""
    rows = grid.join(changes, ["stream_id", "tick"], "left").select("stream_id", "tick", F.floor(F.col("tick") / block).alias("_block"), *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])
    earlier = Window.partitionBy("stream_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    carried = rows.groupBy("stream_id", "_block").agg(*[F.sum(c).alias(c) for c in columns]).select("stream_id", "_block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in columns])
    within = Window.partitionBy("stream_id", "_block").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carried, ["stream_id", "_block"]).select("stream_id", "tick", *[(F.sum(c).over(within) + F.col(f"_{c}")).alias(c) for c in columns])


def overlap(rel: DataFrame, grid: DataFrame, w: Windows = Windows()) -> DataFrame:
    """Jaccard similarity of the users of [t - V, t) and [t - 2V, t - V); null for the first 2V ticks and without any user.

    A run of a user's seconds is seen now from its start to V past its end, before V later, and both where these meet,
    or where the run before is still seen. Each run is a few changes of the counts, whatever its length.
    """
    v = w.overlap_window
    a, b, before = F.col("a"), F.col("b"), F.col("before")

    def seen(first: Column, last: Column, n_any: int, n_both: int) -> list[Column]:
        """The counts change where an interval begins and after it ends; an empty one changes nothing."""
        some = last >= first
        return [
            F.struct(F.when(some, tick).alias("tick"), F.lit(sign * n_any).cast("bigint").alias("n_any"), F.lit(sign * n_both).cast("bigint").alias("n_both"))
            for tick, sign in ((first, 1), (last + 1, -1))
        ]

    changes = [
        *seen(a + 1, b + v, 1, 0),
        *seen(a + v + 1, b + 2 * v, 1, 0),
        *seen(a + v + 1, b + v, -1, 1),
        *seen(a + 1, F.when(before.isNotNull(), F.least(b + v, before + 2 * v)), -1, 1),
    ]
    rows = presence(rel, v).select("stream_id", F.inline(F.array(*changes))).where("tick is not null")
    counts = accumulated(rows.groupBy("stream_id", "tick").agg(F.sum("n_any").alias("n_any"), F.sum("n_both").alias("n_both")), grid, "n_any", "n_both")
    known = (F.col("tick") >= 2 * v) & (F.col("n_any") > 0)
    return counts.select("stream_id", "tick", *[F.when(known, F.col(c)).alias(c) for c in ("n_both", "n_any")], F.when(known, F.col("n_both") / F.col("n_any")).alias("overlap"))


def repeat_ratio(rel: DataFrame, grid: DataFrame, w: Windows = Windows(), min_repeats: int = 3) -> DataFrame:
    """Share of a window's messages whose text occurs at least min_repeats (2 or more) times in it; windows at the start are partial."""
    k = max(2, min_repeats)
    per_second = rel.where("sec >= 0").groupBy("stream_id", "sec", "text_norm").agg(F.count("*").alias("c"))
    per_text = scattered(per_second, w.window).groupBy("stream_id", "tick", "text_norm").agg(F.sum("c").alias("c"))
    per_tick = per_text.groupBy("stream_id", "tick").agg(F.sum(F.when(F.col("c") >= k, F.col("c")).otherwise(0)).alias("n_repeated"), F.sum("c").alias("n_window"))
    out = grid.join(per_tick, ["stream_id", "tick"], "left")
    return out.select("stream_id", "tick", "n_repeated", "n_window", (F.col("n_repeated") / F.col("n_window")).alias("repeat_ratio"))


def spam_mask(repeat: DataFrame, concentration: DataFrame, p: DetectionParams = DetectionParams()) -> DataFrame:
    """Ticks that a few users flood with the same text; undefined values count as no."""
    out = repeat.select("stream_id", "tick", "repeat_ratio").join(concentration.select("stream_id", "tick", "concentration"), ["stream_id", "tick"], "full")
    return out.select("stream_id", "tick", F.coalesce((F.col("repeat_ratio") >= p.spam_min_ratio) & (F.col("concentration") >= p.spam_concentration), F.lit(False)).alias("spam"))

