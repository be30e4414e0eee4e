"""Sends this package to the executors, for sessions whose Python workers don't have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's sources as a zip to the application, once; Spark's file server hands it to every executor."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark
