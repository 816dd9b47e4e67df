"""Make this package importable in Python workers.

Functions that run on executors refer to modules of this package.  Where the
cluster does not have it installed, a zip of its sources is shipped with the session.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if root.endswith(".zip/quorumcast"):  # runs from a shipped zip already
        return
    # A local file of the driver, which Spark's file server hands to the executors.
    path = os.path.join(tempfile.mkdtemp(prefix="quorumcast-"), "quorumcast.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
