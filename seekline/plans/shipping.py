"""Sending the package to executors that don't have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's files once; Spark's own file server hands it to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    own = tempfile.mkdtemp(prefix="seekline-")  # read by the driver's file server alone
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    path = Path(own) / "seekline.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _sent.add(sc.applicationId)
