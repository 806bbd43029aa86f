"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # long texts fill a batch by bytes well before they fill it by rows


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once for each Spark context, so a job needs no path set on the executors.

    Arrow batches get a bound in bytes where the session has none, so what a task holds at once doesn't grow with its texts.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_keysift_sent", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="keysift-")) / "keysift.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*")):
            if p.suffix in {".py", ".json"}:
                z.write(p, p.relative_to(here.parent))
    context.addPyFile(str(target))
    context._keysift_sent = True
