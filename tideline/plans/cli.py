"""Command line: analyse recorder files and print the report, or plan clips and write their manifest.

    python -m tideline.plans.cli report FILE_OR_FOLDER [--threshold-mode sigma|robust|percentile] ...
    python -m tideline.plans.cli clips FILE_OR_FOLDER --out FOLDER ...
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.text import recorder_start_ms
from tideline.operators import clips, cutting
from tideline.operators import sessions as sessions_op
from tideline.params import DetectionParams
from tideline.plans import manifest, report
from tideline.plans.analysis import Analysis
from tideline.sources import chat_xml, media


def session_messages(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Messages of a folder's sessions, without repeats; the sessions; each chunk's status; chunks of no known streamer."""
    read = chat_xml.contents(chat_xml.files(spark, root)).cache()
    chunks = chat_xml.chunk_table(read, chat_xml.listed(spark, root))
    known, unknown = sessions_op.classified(chunks)
    found = sessions_op.sessions(known)
    own = session_paths(found)
    from tideline.operators.prepare import deduplicated

    rows = chat_xml.messages(read).drop("stream_id").join(own, "path").select("stream_id", "uid", "ts_ms", "text")
    return deduplicated(rows), found, read.select("path", "status", "reason"), unknown.select("path")


def session_paths(sessions: DataFrame) -> DataFrame:
    """stream_id and path of each session's chunks."""
    return sessions.select(F.concat_ws("/", "platform", "user_name", "label").alias("stream_id"), F.explode("chunks.path").alias("path"))


def _messages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Messages, status of files, streams (stream_id, path), and files of no known streamer."""
    if os.path.isdir(path):
        rows, found, status, unknown = session_messages(spark, path)
        return rows, status, session_paths(found), [r["path"] for r in unknown.orderBy("path").collect()]
    with open(path, "rb") as f:
        read = chat_xml.contents(chat_xml.uploaded(spark, path, f.read())).cache()
    streams = spark.createDataFrame([(path, f"file:{os.path.abspath(path)}")], "stream_id string, path string")
    return chat_xml.messages(read).select("stream_id", "uid", "ts_ms", "text"), read.select("path", "status", "reason"), streams, []


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tideline", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("report", "clips"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--threshold-mode", choices=("sigma", "robust", "percentile"), default="sigma")
        s.add_argument("--candidate-sigma", type=float, default=2.0)
        s.add_argument("--strong-sigma", type=float, default=3.0)
        s.add_argument("--min-duration", type=int, default=3)
        s.add_argument("--merge-gap", type=int, default=30)
        s.add_argument("--no-spam-filter", action="store_true")
        s.add_argument("--score", action="store_true")
        if name == "clips":
            s.add_argument("--out", required=True)
            s.add_argument("--pre-roll", type=float, default=10.0)
            s.add_argument("--post-roll", type=float, default=15.0)
            s.add_argument("--max-duration", type=float, default=300.0)
            s.add_argument("--anchor-ms", type=int)
            s.add_argument("--fast", action="store_true")
            s.add_argument("--ffmpeg", default="ffmpeg")
            s.add_argument("--ffprobe", default="ffprobe")
            s.add_argument("--dry-run", action="store_true", help="print the commands, run and probe nothing")
    return p


def video_chunks(spark: SparkSession, path: str, streams: DataFrame) -> DataFrame:
    """Recordings beside the chat files: stream_id, path, start_ms, end_ms. Unnamed starts are the file's own time."""
    every = media.listed(spark, path if os.path.isdir(path) else os.path.dirname(os.path.abspath(path)))
    pairs = media.paired(streams.select("path"), every).where("video is not null")
    name = F.element_at(F.split("video", "/"), -1)
    chunks = streams.join(pairs, "path").join(every.select(F.col("path").alias("video"), "changed_ms"), "video")
    return clips.chunk_ends(chunks.select("stream_id", F.col("video").alias("path"), F.coalesce(recorder_start_ms(name), "changed_ms").alias("start_ms")))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if not os.path.exists(args.path):
        print(f"no such file or folder: {args.path}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("tideline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows, status, streams, unknown = _messages(spark, args.path)
    bad = status.where("status <> 'ok'").collect()
    for r in bad:
        print(f"{r['status']}: {r['path']}: {r['reason']}", file=sys.stderr)
    for p in unknown:
        print(f"unclassified: {p}: no platform or streamer", file=sys.stderr)
    if rows.isEmpty():
        print("no messages", file=sys.stderr)
        return 1
    detection = DetectionParams(
        threshold_mode=args.threshold_mode, candidate_sigma=args.candidate_sigma, strong_sigma=args.strong_sigma, min_duration=args.min_duration, merge_gap=args.merge_gap, spam_filter=not args.no_spam_filter
    )
    a = Analysis(rows, detection=detection, cached=True)
    if args.command == "report":
        print(report.text(a))
        if args.score:
            a.scored.select("stream_id", "cand_id", "score", "grade").orderBy("stream_id", "cand_id").show(200, truncate=False)
        return 0
    anchors = rows.groupBy("stream_id").agg(F.lit(args.anchor_ms).cast("bigint").alias("anchor_ms") if args.anchor_ms is not None else F.min("ts_ms").alias("anchor_ms"))
    plan = clips.plan(a.candidates, anchors, args.pre_roll, args.post_roll, args.max_duration)
    parts = clips.segments(plan, video_chunks(spark, args.path, streams)).withColumn("output", clips.output_name())
    parts = parts.cache()
    if args.dry_run:
        for r in parts.orderBy("stream_id", "cand_id", "segment_index").select(F.array_join(clips.cut_command(args.ffmpeg, args.fast, args.out), " ").alias("c")).toLocalIterator():
            print(r["c"])
    done = cutting.results(parts, args.out, args.ffmpeg, args.ffprobe, args.fast, args.dry_run).cache()
    n = manifest.write(clips.manifest(parts, done), os.path.join(args.out, "manifest.csv"))
    for r in done.where("status not in ('ok', 'dry-run')").orderBy("stream_id", "cand_id", "segment_index").toLocalIterator():
        print(f"{r['status']}: clip {r['cand_id']} segment {r['segment_index']}{': ' + r['error'] if r['error'] else ''}", file=sys.stderr)
    print(f"{n} segments", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
