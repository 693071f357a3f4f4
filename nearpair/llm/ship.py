"""Makes the package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import nearpair

_SHIPPED: dict[str, str] = {}  # application -> archive


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application (as --py-files does)."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(nearpair.__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="nearpair-")) / "nearpair.zip"
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(str(path))
        _SHIPPED[context.applicationId] = str(path)
