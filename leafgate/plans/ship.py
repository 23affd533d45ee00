"""Getting the package to the Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """spark, after this package was sent to its executors (once for each application)."""
    app = spark.sparkContext.applicationId
    if app not in _done:
        top = Path(__file__).resolve().parents[2]
        at = Path(tempfile.mkdtemp(prefix="spark-"), "leafgate.zip")
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted((top / "leafgate").rglob("*.py")):
                z.write(f, f.relative_to(top))
        spark.sparkContext.addPyFile(str(at))
        _done.add(app)
    return spark
