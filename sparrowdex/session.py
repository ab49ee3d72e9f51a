"""Makes the package importable on the executors of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's own sources to every executor, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="sparrowdex-src-"), "sparrowdex_src.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    return spark
