"""Send the package to the executors, so that functions which run in Python workers can import it there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SHIPPED_CONF = "spark.rollbook.shipped"


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the session's Python files, once per application."""
    context = spark.sparkContext
    if spark.conf.get(SHIPPED_CONF, None) == context.applicationId:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="rollbook-package-")) / "rollbook.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for module in sorted(package.rglob("*.py")):
            file.write(module, str(module.relative_to(package.parent)))
    context.addPyFile(str(archive))
    spark.conf.set(SHIPPED_CONF, context.applicationId)
