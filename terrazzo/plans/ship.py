"""Make this package importable in Python workers, wherever the executors run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_terrazzo_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="terrazzo-"), "terrazzo.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._terrazzo_shipped = True
