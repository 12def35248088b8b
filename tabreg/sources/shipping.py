"""Making the package importable inside Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application (what ``--py-files`` does at submit time)."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(home):  # already inside a shipped archive otherwise
        target = os.path.join(tempfile.mkdtemp(prefix="tabreg-ship-"), "tabreg")
        context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(home), os.path.basename(home)))
    _SHIPPED.add(context.applicationId)
