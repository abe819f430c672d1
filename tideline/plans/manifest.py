"""Writing a clip manifest as one CSV file."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.clips import MANIFEST


def write(manifest: DataFrame, path: str) -> int:
    """Rows of the manifest in order, with a header, as UTF-8 with a byte-order mark; an existing file is replaced.

    Rows come one partition at a time, so the driver holds no more than that. Returns their number.
    """
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with target.open("w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f)
        out.writerow(MANIFEST)
        for row in manifest.select(*MANIFEST).orderBy("clip_index", "segment_index").toLocalIterator():
            out.writerow(row)
            n += 1
    return n


def write_distributed(manifest: DataFrame, path: str) -> None:
    """The same rows as a folder of CSV files, for many streams."""
    manifest.select(*[F.col(c).cast("string") for c in MANIFEST]).write.mode("overwrite").option("header", True).csv(path)
