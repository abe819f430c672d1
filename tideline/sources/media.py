"""Recordings beside chat files: their pairing, and what a media probe says about them."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.text import recorder_start_ms
from tideline.operators.clips import VIDEO_KINDS
from tideline.shipping import ship_package


class MediaError(RuntimeError):
    """A recording that is missing, ambiguous or unreadable."""


def _split(df: DataFrame, prefix: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(
        F.col("path").alias(f"{prefix}_path"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_replace(name, "\\.[^.]*$", "").alias(f"{prefix}_stem"),
        F.when(recorder_start_ms(name).isNotNull(), F.substring(name, 1, 23)).alias(f"{prefix}_time"),
    )


def paired(chat: DataFrame, videos: DataFrame) -> DataFrame:
    """Each chat file's recording in its folder: path, video and problem (null, missing or ambiguous).

    The one with the same name but for its kind, else the one whose name starts with the same time.
    """
    kind = F.lower(F.regexp_extract("path", "(\\.[^./]*)$", 1))
    v = _split(videos.where(kind.isin(*VIDEO_KINDS)), "v")
    c = _split(chat, "c")
    by_stem = c.join(v, (c["folder"] == v["folder"]) & (F.col("c_stem") == F.col("v_stem")), "left").groupBy("c_path").agg(F.count("v_path").alias("n_stem"), F.min("v_path").alias("stem"))
    by_time = c.join(v, (c["folder"] == v["folder"]) & (F.col("c_time") == F.col("v_time")), "left").groupBy("c_path").agg(F.count("v_path").alias("n_time"), F.min("v_path").alias("time"))
    n = F.when(F.col("n_stem") > 0, F.col("n_stem")).otherwise(F.col("n_time"))
    return by_stem.join(by_time, "c_path").select(
        F.col("c_path").alias("path"), F.when(n == 1, F.coalesce(F.when(F.col("n_stem") > 0, F.col("stem")), "time")).alias("video"), F.when(n == 0, "missing").when(n > 1, "ambiguous").alias("problem")
    )


def probe_result(output: str) -> tuple[float, bool, bool]:
    """Duration in seconds, and whether there is video and audio, of the probe's JSON."""
    try:
        found = json.loads(output)
        kinds = {s.get("codec_type") for s in found.get("streams", [])}
        return float(found["format"]["duration"]), "video" in kinds, "audio" in kinds
    except (ValueError, KeyError, TypeError) as e:
        raise MediaError(f"unreadable probe output: {e}") from e


def probe(path: str, ffprobe: str = "ffprobe", timeout: int = 120) -> tuple[float, bool, bool]:
    """Run the media probe on one file."""
    try:
        done = subprocess.run([ffprobe, "-v", "error", "-print_format", "json", "-show_format", "-show_streams", path], capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise MediaError(f"{path}: {e}") from e
    if done.returncode:
        raise MediaError(f"{path}: {done.stderr.strip()}")
    return probe_result(done.stdout)


PROBE_SCHEMA = "path string, duration_s double, has_video boolean, has_audio boolean, problem string"


def probed(files: DataFrame, ffprobe: str = "ffprobe") -> DataFrame:
    """What the probe says about each file (path): duration_s, has_video, has_audio, or the problem. Files are probed in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    rows.append((path, *probe(path.removeprefix("file://").removeprefix("file:"), ffprobe), None))
                except MediaError as e:
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in PROBE_SCHEMA.split(", ")]).astype({"has_video": "object", "has_audio": "object"})

    ship_package(files.sparkSession)
    return files.select("path").mapInPandas(run, PROBE_SCHEMA)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path and changed_ms of every file under a folder of any store that Spark reads; contents aren't."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.unix_millis("modificationTime").alias("changed_ms"))
