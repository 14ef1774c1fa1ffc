"""The package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors where PYTHONPATH doesn't do it already."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT) in paths or Path.cwd() == ROOT or getattr(spark.sparkContext, "_larkveil_sent", False):
        return
    target = Path(tempfile.mkdtemp(prefix="larkveil-zip-")) / "larkveil.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "larkveil").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))  # Spark's file server hands it to the executors
    spark.sparkContext._larkveil_sent = True


def shipped(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run
