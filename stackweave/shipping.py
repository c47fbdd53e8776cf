"""Makes the package importable for Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


def reachable() -> bool:
    """Workers find the package by themselves: it is in their working directory or on PYTHONPATH."""
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return any(p and Path(p).resolve() == ROOT for p in paths)


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the workers, once a context, where they can't reach it."""
    context = spark.sparkContext
    if reachable() or getattr(context, "_stackweave_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="stackweave-code-"), "stackweave.zip")  # Spark copies it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for path in [*(ROOT / "stackweave").rglob("*.py"), *ROOT.glob("corpus_pipeline.py")]:
            z.write(path, path.relative_to(ROOT))
    context.addPyFile(archive)
    context._stackweave_shipped = True
