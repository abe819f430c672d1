"""Clip planning: intervals of a stream to cuts in its recording's files, and the commands that make them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import media_time

#: Columns of the manifest, in order.
MANIFEST = (
    "clip_index", "grade", "shape", "level", "t_start", "t_end", "peak_t", "abs_start_ms", "abs_end_ms", "overlaps_previous",
    "segment_index", "n_segments", "source", "local_start_ms", "local_end_ms", "output", "status", "actual_duration_s", "has_video", "has_audio",
)
#: File kinds of recordings.
VIDEO_KINDS = (".flv", ".mp4", ".ts", ".mkv", ".mov")


def chunk_ends(chunks: DataFrame, contiguous_ms: int = 3_600_000) -> DataFrame:
    """chunks (stream_id, path, start_ms) with end_ms: the next one's start if that is near, else null."""
    by = Window.partitionBy("stream_id").orderBy("start_ms", "path")
    following = F.lead("start_ms").over(by)
    return chunks.withColumn("end_ms", F.when(following - F.col("start_ms") <= contiguous_ms, following))


def _ms(ticks: Column, tick_ms: int) -> Column:
    return F.bround(ticks * tick_ms, 0).cast("bigint")


def plan(intervals: DataFrame, anchors: DataFrame, pre_roll: float = 10.0, post_roll: float = 15.0, max_duration: float = 300.0, tick_ms: int = 1000) -> DataFrame:
    """Intervals with abs_start_ms, abs_end_ms and overlaps_previous. anchors: stream_id and anchor_ms, when t is 0.

    A clip over max_duration seconds (0: no limit) is cut to it around its peak.
    """
    anchor = F.col("anchor_ms")
    start, end = anchor + _ms(F.col("t_start"), tick_ms) - round(pre_roll * 1000), anchor + _ms(F.col("t_end"), tick_ms) + round(post_roll * 1000)
    out = intervals.join(anchors.select("stream_id", "anchor_ms"), "stream_id").withColumn("_start", start).withColumn("_end", end)
    cap = round(max_duration * 1000) if max_duration > 0 else 0
    long = (F.col("_end") - F.col("_start") > cap) if cap else F.lit(False)
    peak = anchor + _ms(F.col("peak_t"), tick_ms)
    out = out.withColumn("abs_start_ms", F.when(long, F.greatest(F.col("_start"), peak - cap // 2)).otherwise(F.col("_start")))
    out = out.withColumn("abs_end_ms", F.when(long, F.least(F.col("_end"), peak + cap // 2)).otherwise(F.col("_end")))
    before = F.lag("abs_end_ms").over(Window.partitionBy("stream_id").orderBy("cand_id"))
    return out.withColumn("overlaps_previous", F.coalesce(F.col("abs_start_ms") < before, F.lit(False))).drop("_start", "_end", "anchor_ms")


def segments(clips: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each clip and each file that it cuts into, with segment_index and n_segments; holes aren't covered.

    Files and clips are joined by stream and by the hours that both touch, so the join is one of equals.
    """
    hour = 3_600_000
    touched = clips.withColumn("_hour", F.explode(F.sequence(F.floor(F.col("abs_start_ms") / hour), F.floor(F.col("abs_end_ms") / hour))))
    bounded = chunks.where("end_ms is not null").withColumn("_hour", F.explode(F.sequence(F.floor(F.col("start_ms") / hour), F.floor(F.col("end_ms") / hour))))
    own = ["stream_id", F.col("path").alias("source"), F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to")]
    lo = F.greatest("abs_start_ms", "_from")
    closed = touched.join(bounded.select(*own, "_hour"), ["stream_id", "_hour"])
    # a file of unknown end covers all after its start; there is one for each break of a recording
    open_ = clips.join(chunks.where("end_ms is null").select(*own), "stream_id")
    parts = [x.select(*clips.columns, "source", "_from", lo.alias("_lo"), F.least("abs_end_ms", F.coalesce("_to", "abs_end_ms")).alias("_hi")) for x in (closed, open_)]
    found = parts[0].dropDuplicates(["stream_id", "cand_id", "source", "_from"]).unionByName(parts[1]).where("_lo < _hi")
    by = Window.partitionBy("stream_id", "cand_id")
    return found.select(
        *clips.columns, "source", (F.col("_lo") - F.col("_from")).alias("local_start_ms"), (F.col("_hi") - F.col("_from")).alias("local_end_ms"),
        (F.row_number().over(by.orderBy("_from", "source")) - 1).cast("bigint").alias("segment_index"), F.count("*").over(by).alias("n_segments"),
    )


def output_name() -> Column:
    """clip_000_level_shape_HH-mm-ss-HH-mm-ss[_pN].mp4 of a segment."""
    at = [F.date_format(F.timestamp_millis(c), "HH-mm-ss") for c in ("abs_start_ms", "abs_end_ms")]
    part = F.when(F.col("n_segments") > 1, F.format_string("_p%d", F.col("segment_index") + 1)).otherwise("")
    return F.concat(F.format_string("clip_%03d_", F.col("cand_id")), "level", F.lit("_"), "shape", F.lit("_"), at[0], F.lit("-"), at[1], part, F.lit(".mp4"))


def cut_command(ffmpeg: str = "ffmpeg", fast: bool = False, folder: str | None = None) -> Column:
    """The argument list that cuts a segment, re-encoded or (fast) copied; the last one is the file made, in the folder if given."""
    codec = ["-c", "copy"] if fast else ["-c:v", "libx264", "-c:a", "aac"]
    seconds = F.format_string("%.3f", (F.col("local_end_ms") - F.col("local_start_ms")) / 1000)
    return F.array(*map(F.lit, (ffmpeg, "-y", "-ss")), media_time(F.col("local_start_ms")), F.lit("-i"), F.col("source"), F.lit("-t"), seconds, *map(F.lit, codec), output_name() if folder is None else F.concat(F.lit(folder.rstrip("/") + "/"), output_name()))


def manifest(segments: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """The manifest's columns, one row a segment. results: stream_id, cand_id, segment_index and outcome columns; empty without.

    grade is the interval's grade where it was scored, else its level.
    """
    outcome = MANIFEST[15:]
    rows = segments
    if results is not None:
        keys = ["stream_id", "cand_id", "segment_index"]
        rows = rows.join(results.select(*keys, *[c for c in results.columns if c in outcome and c not in rows.columns]), keys, "left")
    one = [F.format_string("%.1f", F.col(c).cast("double")).alias(c) for c in ("t_start", "t_end", "peak_t")]
    graded = F.col("grade") if "grade" in rows.columns else F.col("level")
    return rows.select(
        F.col("cand_id").alias("clip_index"), graded.alias("grade"), "shape", "level", *one, "abs_start_ms", "abs_end_ms", "overlaps_previous", "segment_index", "n_segments", "source", "local_start_ms", "local_end_ms",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in outcome],
    )
