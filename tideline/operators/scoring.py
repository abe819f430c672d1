"""Composite scores: six signals a tick, their weighted heat, scored and graded intervals, and the stream's own score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import grade
from tideline.operators.detect import exploded
from tideline.params import GRADES, TICK_METRICS, GradeThresholds, MetricWeights


def _over_max(value: Column, most: Column) -> Column:
    return F.when(most == 0, value * 0.0).otherwise(value / most)


def signals(ticks: DataFrame) -> DataFrame:
    """Signals in [0, 1] of rows with d, s, activation, short_ratio, concentration and overlap; undefined ones stay null."""
    rise = F.when(F.col("s").isNotNull(), F.greatest(F.col("s"), F.lit(0.0)))
    most = ticks.groupBy("stream_id").agg(F.max("d").alias("_most_d"), F.max(rise).alias("_most_s"))
    return ticks.join(most, "stream_id").select(
        "stream_id", "tick", _over_max(F.col("d"), F.col("_most_d")).alias("density"), _over_max(rise, F.col("_most_s")).alias("burst"), F.col("activation"),
        F.col("short_ratio").alias("length_mix"), (1 - F.col("concentration")).alias("concentration"), (1 - F.col("overlap")).alias("overlap"),
    )


def _weighted_mean(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """The mean of what is defined, weights scaled to what is defined; null if nothing is or weights sum to nothing."""
    up = reduce(lambda a, b: a + b, [F.coalesce(v * F.lit(weights[k]), F.lit(0.0)) for k, v in values.items()])
    down = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, v in values.items()])
    return up / F.when(down > 0, down)


def heat(signals: DataFrame, weights: MetricWeights = MetricWeights()) -> DataFrame:
    """stream_id, tick and heat."""
    return signals.select("stream_id", "tick", _weighted_mean({k: F.col(k) for k in TICK_METRICS}, weights.heat()).alias("heat"))


def scored(intervals: DataFrame, signals: DataFrame, heat: DataFrame, lifecycle: DataFrame, returning: DataFrame, weights: MetricWeights = MetricWeights(), thresholds: GradeThresholds = GradeThresholds()) -> DataFrame:
    """Intervals with score, grade, heat_mean, heat_peak, converted_ratio and returning_ratio.

    Density and burst count by their peak in the interval, the other signals by their mean.
    """
    inside = exploded(intervals, "cand_id").join(signals, ["stream_id", "tick"]).join(heat, ["stream_id", "tick"])
    found = inside.groupBy("stream_id", "cand_id").agg(
        *[F.max(k).alias(k) for k in ("density", "burst")], *[F.avg(k).alias(k) for k in ("activation", "length_mix", "concentration", "overlap")], F.avg("heat").alias("_heat_mean"), F.max("heat").alias("_heat_peak")
    )
    won = lifecycle.select("stream_id", "cand_id", F.coalesce(F.col("converted") / F.when(F.col("total_users") > 0, F.col("total_users")), F.lit(0.0)).alias("lifecycle"))
    back = returning.select("stream_id", "cand_id", F.coalesce("ratio", F.lit(0.0)).alias("returning"))
    keys = ["stream_id", "cand_id"]
    out = intervals.join(found, keys, "left").join(won, keys, "left").join(back, keys, "left")
    out = out.withColumn("lifecycle", F.coalesce("lifecycle", F.lit(0.0))).withColumn("returning", F.coalesce("returning", F.lit(0.0)))
    effective = weights.effective()
    score = F.least(F.greatest(F.coalesce(_weighted_mean({k: F.col(k) for k in effective}, effective), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    out = out.withColumn("score", score)
    return out.select(
        *intervals.columns, "score", grade(F.col("score"), thresholds).alias("grade"), F.coalesce("_heat_mean", F.lit(0.0)).alias("heat_mean"), F.coalesce("_heat_peak", F.lit(0.0)).alias("heat_peak"),
        F.col("lifecycle").alias("converted_ratio"), F.col("returning").alias("returning_ratio"),
    )


def overall(heat: DataFrame, thresholds: GradeThresholds = GradeThresholds()) -> DataFrame:
    """One row a stream: half the mean heat and half the peak, and its grade."""
    both = heat.groupBy("stream_id").agg((0.5 * F.coalesce(F.avg("heat"), F.lit(0.0)) + 0.5 * F.coalesce(F.max("heat"), F.lit(0.0))).alias("overall_score"))
    return both.withColumn("overall_grade", grade(F.col("overall_score"), thresholds))


def grade_counts(scored: DataFrame) -> DataFrame:
    """One row a stream: intervals of each grade."""
    return scored.groupBy("stream_id").agg(*[F.count_if(F.col("grade") == g).alias(f"n_{g.lower()}") for g in GRADES])
