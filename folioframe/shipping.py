"""Make this code importable in the executors' Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="folioframe-")
    atexit.register(shutil.rmtree, folder, True)
    name = f"{folder}/folioframe.zip"
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted(top.glob("folioframe/**/*.py")) + sorted(top.glob("*.py")):
            out.write(path, path.relative_to(top).as_posix())
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
