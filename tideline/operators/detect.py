"""Highlight detection: thresholds from a stream's whole density curve, runs above them, merging, peaks and levels.

Thresholds compare whole counts with mu + k sigma from whole-number moments (n, sum, sum of squares), so that they
don't depend on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import shape
from tideline.params import DetectionParams


def moments(density: DataFrame) -> DataFrame:
    """n, sum_d, sum_d2, mu, sigma and _root (n sigma) of defined densities, one row a stream.

    mu + k _root / n, in this order, gives whole thresholds where they are whole; k sigma would round twice.
    """
    sums = density.groupBy("stream_id").agg(F.count("d").alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("sum_d"), F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0)).alias("sum_d2"))
    n = F.when(F.col("n") > 0, F.col("n"))
    spread = F.col("n") * F.col("sum_d2") - F.col("sum_d") * F.col("sum_d")
    return sums.withColumn("_root", F.sqrt(spread)).withColumn("mu", F.coalesce(F.col("sum_d") / n, F.lit(0.0))).withColumn("sigma", F.coalesce(F.col("_root") / n, F.lit(0.0)))


def thresholds(density: DataFrame, p: DetectionParams = DetectionParams()) -> DataFrame:
    """One row a stream: mu, sigma, n, candidate_threshold and strong_threshold (null without a baseline)."""
    base = moments(density)
    by_sigma = [F.when(F.col("sigma") > 0, F.col("mu") + k * F.col("_root") / F.col("n")) for k in (p.candidate_sigma, p.strong_sigma)]
    if p.threshold_mode == "percentile":
        cuts = density.groupBy("stream_id").agg(F.percentile("d", p.candidate_percentile / 100).alias("_c"), F.percentile("d", p.strong_percentile / 100).alias("_s"))
        out = base.join(cuts, "stream_id")
        derived, baseline = [F.col("_c"), F.col("_s")], F.col("n") > 0
    elif p.threshold_mode == "robust":
        mid = density.groupBy("stream_id").agg(F.median("d").alias("_med"))
        away = density.join(mid, "stream_id").groupBy("stream_id").agg(F.first("_med").alias("_med"), F.median(F.abs(F.col("d") - F.col("_med"))).alias("_mad"))
        out = base.join(away, "stream_id", "left")
        mad = F.col("_mad") * 1.4826
        derived = [F.when(mad > 0, F.col("_med") + k * mad).otherwise(s) for k, s in zip((p.candidate_sigma, p.strong_sigma), by_sigma, strict=True)]
        baseline = (F.col("n") > 0) & ((mad > 0) | (F.col("sigma") > 0))
    else:
        out, derived, baseline = base, by_sigma, (F.col("n") > 0) & (F.col("sigma") > 0)
    explicit = [p.candidate_threshold, p.strong_threshold]
    cuts = [F.when(baseline, d if e is None else F.lit(float(e))) for d, e in zip(derived, explicit, strict=True)]
    return out.select("stream_id", "n", "mu", "sigma", cuts[0].alias("candidate_threshold"), cuts[1].alias("strong_threshold"))


def above(density: DataFrame, thresholds: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Ticks over the candidate threshold, but those that exclude marks as spam."""
    hot = density.join(thresholds.select("stream_id", "candidate_threshold"), "stream_id").where(F.col("d") > F.col("candidate_threshold"))
    if exclude is not None:
        hot = hot.join(exclude.where("spam").select("stream_id", "tick"), ["stream_id", "tick"], "left_anti")
    return hot.select("stream_id", "tick", "d")


def runs(hot: DataFrame) -> DataFrame:
    """Longest runs of consecutive ticks: stream_id, run_start, run_end. The window sees ticks above the threshold alone."""
    island = F.col("tick") - F.row_number().over(Window.partitionBy("stream_id").orderBy("tick"))
    return hot.select("stream_id", "tick", island.alias("_island")).groupBy("stream_id", "_island").agg(F.min("tick").alias("run_start"), F.max("tick").alias("run_end")).drop("_island")


def merged(runs: DataFrame, merge_gap: int = 30, overlap: DataFrame | None = None, overlap_min: float = 0.5) -> DataFrame:
    """Runs closer than merge_gap to the run before become one, unless the users' overlap at the later start is known and low."""
    by = Window.partitionBy("stream_id").orderBy("run_start")
    allowed: Column = F.lit(True)
    if overlap is not None:
        at = overlap.select("stream_id", F.col("tick").alias("run_start"), F.col("overlap").alias("_overlap"))
        runs = runs.join(at, ["stream_id", "run_start"], "left")
        allowed = F.coalesce(F.col("_overlap") >= overlap_min, F.lit(True))
    joins = (F.col("run_start") - F.lag("run_end").over(by) < merge_gap) & allowed
    opens = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    numbered = runs.withColumn("_opens", opens).withColumn("_group", F.sum("_opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("stream_id", "_group").agg(F.min("run_start").alias("t_start"), F.max("run_end").alias("t_end")).drop("_group")


def exploded(intervals: DataFrame, *keep: str) -> DataFrame:
    """Intervals once for each tick that they hold, to be joined by equality."""
    return intervals.select("stream_id", "t_start", "t_end", *keep, F.explode(F.sequence("t_start", "t_end")).alias("tick"))


def candidates(density: DataFrame, thresholds: DataFrame, p: DetectionParams = DetectionParams(), exclude: DataFrame | None = None, overlap: DataFrame | None = None, tick_seconds: float = 1.0) -> DataFrame:
    """stream_id, cand_id (from 0 by peak), t_start, t_end, peak_t, peak_density, level, duration and shape.

    A peak is the earliest highest density of the whole merged span, ticks below the threshold or excluded among them.
    """
    spans = merged(runs(above(density, thresholds, exclude)), p.merge_gap, overlap if p.use_merge_overlap else None, p.merge_overlap_min)
    if p.min_duration > 0:
        spans = spans.where(F.col("t_end") - F.col("t_start") >= p.min_duration)
    peak = F.max(F.struct("d", (-F.col("tick")).alias("_neg"))).alias("_peak")
    peaks = exploded(spans).join(density.where("d is not null"), ["stream_id", "tick"]).groupBy("stream_id", "t_start", "t_end").agg(peak)
    out = peaks.join(thresholds.select("stream_id", "strong_threshold"), "stream_id")
    duration = F.col("t_end") - F.col("t_start")
    out = out.select(
        "stream_id", "t_start", "t_end", (-F.col("_peak._neg")).alias("peak_t"), F.col("_peak.d").alias("peak_density"),
        F.when(F.col("_peak.d") > F.col("strong_threshold"), "strong").otherwise("candidate").alias("level"), duration.alias("duration"), shape(duration * tick_seconds).alias("shape"),
    )
    by = Window.partitionBy("stream_id").orderBy("peak_t", "t_start")
    return out.select("stream_id", (F.row_number().over(by) - 1).cast("bigint").alias("cand_id"), *[c for c in out.columns if c != "stream_id"])
