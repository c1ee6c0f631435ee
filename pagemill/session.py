"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of the application, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="pagemill-"), "pagemill")
        spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root, "pagemill"))
        _shipped.add(app)
    return spark
