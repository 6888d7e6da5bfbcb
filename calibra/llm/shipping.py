"""Readies a session: the package on executors that don't have it, smaller Arrow batches."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def ship(spark: SparkSession) -> None:
    """Hand the package to Spark's own file distribution, once per application (what
    `--py-files` does).  The archive is made on the driver; executors fetch it from there.

    Arrow batches of whole texts are kept to BATCH_ROWS rows (a smaller setting stays):
    several of them are in memory at once in the JVM and in its Python workers."""
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="calibra-"), "calibra.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("calibra", os.path.relpath(path, top)))
    spark.sparkContext.addPyFile(archive)
    _SENT.add(app)
