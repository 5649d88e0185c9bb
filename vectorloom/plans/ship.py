"""Send this package to the Python workers of a session, wherever they run."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each Spark application; the archive is served by the driver."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        top = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="vectorloom-")
        sc.addPyFile(shutil.make_archive(f"{folder}/{top.name}", "zip", top.parent, top.name))
        _sent.add(sc.applicationId)
