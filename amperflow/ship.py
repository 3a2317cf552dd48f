"""Bring this package to Python workers that do not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Arrow batches into Python workers: at most so many rows, so that a batch of texts is some MB on either side.
BATCH, SPARKS_OWN = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
ROWS = "4000"


def ship(spark: SparkSession) -> None:
    """Send the package's modules along with the session's application, once; smaller Arrow batches where nobody has set their size."""
    if spark.conf.get(BATCH) == SPARKS_OWN:
        spark.conf.set(BATCH, ROWS)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="amperflow-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("amperflow", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
