"""What a session needs to run this package's functions on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes that go to a Python worker at once where the session says nothing: texts are long, and executors hold a batch on
#: both sides.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that it need not be installed there."""
    sc = spark.sparkContext
    if BATCH_BYTES[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH_BYTES)
    if getattr(sc, "_lodestone_shipped", False):
        return
    here = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="spark-")) / "lodestone.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(to))
    sc._lodestone_shipped = True
