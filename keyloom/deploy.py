"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


@cache
def _archive() -> str:
    folder = tempfile.mkdtemp(prefix="keyloom-")
    path = os.path.join(folder, "keyloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    return path


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_keyloom_shipped", None) is None:
        sc.addPyFile(_archive())
        sc._keyloom_shipped = True
