"""Give executors the package's own code, whatever their search path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a SparkContext: send a zip of this package to the executors' Python workers."""
    context = spark.sparkContext
    if getattr(context, "_marlspar_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="marlspar-code-"), "marlspar.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(here.rglob("*.py")):
            out.write(f, f"{here.name}/{f.relative_to(here)}")
    context.addPyFile(path)
    context._marlspar_shipped = True
