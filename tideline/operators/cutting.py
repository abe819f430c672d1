"""Making the clips: one run of the cutter for each segment, in tasks, and a probe of what came out."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tideline.operators.clips import cut_command
from tideline.shipping import ship_package
from tideline.sources.media import MediaError, probe

RESULT_SCHEMA = "stream_id string, cand_id bigint, segment_index bigint, status string, actual_duration_s double, has_video boolean, has_audio boolean, error string"


def local_path(path: str) -> str:
    """A path as programs take it: without Spark's scheme for files."""
    for scheme in ("file://", "file:"):
        if path.startswith(scheme):
            return path[len(scheme) :]
    return path


def cut(command: list[str], ffprobe: str = "ffprobe", timeout: int = 3600) -> tuple[str, float | None, bool | None, bool | None, str | None]:
    """Run a command whose last word is the file that it makes: status, duration, video, audio and the error's end.

    Fixed values of status: ok, failed (the command), invalid (no picture, no sound or no length), probe-failed: and why.
    """
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired) as e:
        return "failed", None, None, None, str(e)[-2000:]
    if done.returncode:
        return "failed", None, None, None, (done.stderr or "").strip()[-2000:]
    try:
        seconds, video, audio = probe(command[-1], ffprobe)
    except MediaError as e:
        return f"probe-failed: {e}", None, None, None, None
    return "ok" if video and audio and seconds > 0 else "invalid", round(seconds, 3), video, audio, None


def results(segments: DataFrame, folder: str, ffmpeg: str = "ffmpeg", ffprobe: str = "ffprobe", fast: bool = False, dry_run: bool = False) -> DataFrame:
    """One row a segment, for the manifest: its key, status and what the probe says. folder: where clips go, shared by all machines.

    dry_run runs nothing. A task that is run again makes the same file again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not dry_run:
            os.makedirs(folder, exist_ok=True)
        for batch in batches:
            rows = []
            for key, words in zip(batch[["stream_id", "cand_id", "segment_index"]].itertuples(index=False), batch["command"], strict=True):
                rows.append((*key, *(("dry-run", None, None, None, None) if dry_run else cut([local_path(w) for w in words], ffprobe))))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RESULT_SCHEMA.split(", ")]).astype({"has_video": "object", "has_audio": "object"})

    ship_package(segments.sparkSession)
    commands = segments.select("stream_id", "cand_id", "segment_index", cut_command(ffmpeg, fast, folder).alias("command"))
    return commands.repartition("stream_id", "cand_id", "segment_index").mapInPandas(run, RESULT_SCHEMA)
