"""Send this library to the executors, for sessions that were not started with it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of rows that go to a Python worker at once.
BATCH = 4 << 20

_sent: set[str] = set()


def to_executors(spark: SparkSession) -> None:
    """Add the package's modules to the session's Python files, once per application."""
    application = spark.sparkContext.applicationId
    if application in _sent:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(application)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by BATCH, unless its own bound is a smaller number of bytes.

    Executors hold a batch on both sides and for rows that come back once more, and Python workers
    keep their largest size from stage to stage.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(bound).rstrip("b")
    if not own.isdigit() or int(own) > BATCH:
        spark.conf.set(bound, str(BATCH))
