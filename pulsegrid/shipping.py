"""Sends this package to executors that do not have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds a zip file of the package to the application, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="pulsegrid-"), "pulsegrid"), "zip", os.path.dirname(_PACKAGE), os.path.basename(_PACKAGE))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark
