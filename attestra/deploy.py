"""Making the package importable on executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless their path has it."""
    paths = {Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    app = spark.sparkContext.applicationId
    if ROOT in paths or app in _shipped:
        return
    target = Path(tempfile.mkdtemp()).resolve() / "attestra_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted((ROOT / "attestra").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
