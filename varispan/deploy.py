"""Puts this package on the executors, however the driver came to import it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers of ``spark`` once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    top = Path(tempfile.mkdtemp(prefix="varispan-ship-"))
    atexit.register(shutil.rmtree, top, ignore_errors=True)
    shutil.copytree(here, top / "src" / here.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(top / f"{here.name}-{app}"), "zip", top / "src"))
    _shipped.add(app)
