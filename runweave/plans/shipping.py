"""Make the package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of the session's application, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="runweave-")) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as made:
        for path in sorted(top.rglob("*.py")):
            made.write(path, path.relative_to(top.parent).as_posix())
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
