"""The package's own code for Python workers that do not have it on their path."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers of this application the package, once, as --py-files would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory(prefix="exposark-") as top:
        copy = Path(top, "code")
        shutil.copytree(root, copy / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="exposark-ship-"), "exposark_code")), "zip", copy)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
