"""Session helpers: the settings this engine expects, and shipping the package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def new_session(name: str = "tideline", master: str | None = None) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; everything else stays as the cluster sets it."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    return (builder.master(master) if master else builder).getOrCreate()


#: Rows and bytes that one Arrow batch holds at most, on either side of the pipe: texts are long, and a task holds several batches.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once an application, and keeps Arrow batches small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(rows, str(min(BATCH_ROWS, int(spark.conf.get(rows, str(BATCH_ROWS))) or BATCH_ROWS)))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tideline-")) / "tideline.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)
