"""Make this package importable in the Python workers of a session."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import fleetlens
from fleetlens.sources.workspace import ensure_shared

#: Rows and bytes that Spark hands to Python at a time: texts are long, and a batch is held several times.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package once per application through Spark's own file server, and set the session up: a shared folder, small batches."""
    ensure_shared(spark)
    for setting, value in BATCHES.items():
        spark.conf.set(setting, value)
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = os.path.dirname(os.path.abspath(fleetlens.__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="fleetlens-ship-"), "fleetlens_llm_code.zip")
    with open(path, "wb") as out:
        out.write(data.getvalue())
    context.addPyFile(path)
    _sent.add(context.applicationId)
