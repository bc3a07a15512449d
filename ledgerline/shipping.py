"""Makes this package importable on the executors, whether or not it is installed there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send the package's sources to every executor, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp()) / "ledgerline.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*")):
                if p.suffix in (".py", ".toml", ".sql"):
                    z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
