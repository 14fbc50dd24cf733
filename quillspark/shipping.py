"""Make the package importable on executors, where the driver's own path doesn't reach them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session; not where all runs on this machine."""
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app in _sent or master == "local" or master.startswith("local["):
        return
    path = Path(tempfile.mkdtemp(prefix="quillspark-")) / "quillspark.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)
