"""What Python workers need: this package, and batches that long texts don't blow up."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that Spark hands to a worker at once: texts may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
_PACKAGE = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, once per application, and bound the session's Arrow batches."""
    rows, size = (f"spark.sql.execution.arrow.{name}PerBatch" for name in ("maxRecords", "maxBytes"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId not in _sent:
        # the driver serves the file to executors that start later, too
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "tessera.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(_PACKAGE.rglob("*.py")):
                archive.write(file, file.relative_to(_PACKAGE.parent))
        context.addPyFile(path)
        _sent.add(context.applicationId)


def fresh(frame: DataFrame, name: str) -> str:
    """A column name like name that frame doesn't have."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name
