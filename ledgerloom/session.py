"""Making the package importable in executors' Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application.

    The archive is built on the driver's disk and served to executors by Spark, so executors need no copy.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="ledgerloom-src-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "ledgerloom-src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
