"""Make this package importable in Python workers that were not started with it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def reachable() -> bool:
    """Whether workers that inherit this process's environment and folder find the package."""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return any(Path(p).resolve() == ROOT for p in (*paths, os.getcwd()))


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all workers of the session, once, if they would not find it.

    Spark itself passes the archive on to executors; a cluster that has the package by --py-files or PYTHONPATH gets nothing.
    """
    sc = spark.sparkContext
    if reachable() or getattr(sc, "_package_sent", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{Path(__file__).parent.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(Path(__file__).parent.rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(archive)
    sc._package_sent = True
