"""Makes this package importable on the executors of a running session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Hand the package's sources to every executor, once for each application; needed only by operators with Python functions."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph_sources.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name, p.relative_to(root)))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark
