"""This package on the executors, for the few operators that run Python there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once for each application, through Spark's own file server."""
    sc = spark.sparkContext
    if getattr(sc, "_concordat_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="concordat-"), "concordat_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join("concordat", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._concordat_shipped = True
