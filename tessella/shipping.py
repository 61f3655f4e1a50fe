"""Making the package known to Python workers that do not find it on their own path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: dict[str, str] = {}


def workers_have_it() -> bool:
    """Workers inherit PYTHONPATH and, in local mode, the working folder."""
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return any(p and Path(p).resolve() == ROOT for p in places)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each application, if they may lack it."""
    app = spark.sparkContext.applicationId
    if workers_have_it() or app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tessella-"), "tessella_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted([*ROOT.glob("tessella/**/*.py"), *ROOT.glob("*.py")]):
            archive.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path
