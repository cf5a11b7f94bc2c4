"""The package on the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Gives every executor this package, once a SparkContext, so that a session works that was started without it on
    its workers' path."""
    sc = spark.sparkContext
    if getattr(sc, "_threadloom_shipped", None) != sc.applicationId:
        root = Path(__file__).resolve().parents[1]
        with tempfile.TemporaryDirectory() as folder:
            top = Path(folder) / "zip" / root.name
            shutil.copytree(root, top, ignore=shutil.ignore_patterns("__pycache__"))
            kept = tempfile.mkdtemp(prefix="threadloom-")
            sc.addPyFile(shutil.make_archive(f"{kept}/threadloom", "zip", top.parent))
        sc._threadloom_shipped = sc.applicationId
    return spark
