"""Sending this package to the executors, so that Python workers can import it on any machine."""

from __future__ import annotations

import io
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_LOCK = threading.Lock()
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package as a zip file, once for each application."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app in _SHIPPED:
            return
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="tideline-")) / f"tideline-{app}.zip"
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        target.write_bytes(buffer.getvalue())
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)
