"""What Python workers need of this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once for each Spark context, so that
    their Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_tallyweave_shipped", False):
        return
    to = Path(tempfile.mkdtemp()) / "tallyweave_sources.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, str(path.relative_to(_PACKAGE.parent)))
    context.addPyFile(str(to))
    context._tallyweave_shipped = True
