"""Ships this package to the executors, for sessions that were started without it on the workers' path."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="lectura-py-")
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "lectura"), "zip", os.path.dirname(here), os.path.basename(here)))
        _shipped.add(sc.applicationId)
