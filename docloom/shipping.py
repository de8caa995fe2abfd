"""Makes this package importable in Python workers, wherever the driver has it from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once in an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="docloom-ship-")) / "docloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(top.rglob("*")):
            if file.suffix in {".py", ".yaml"}:
                archive.write(file, file.relative_to(top.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shipped(df: DataFrame) -> DataFrame:
    ship(df.sparkSession)
    return df
