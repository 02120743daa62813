"""Sends this package to Python workers that do not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers once per application.

    Workers that were started elsewhere, without the repository on their path, can then
    import the functions that ``mapInArrow`` and ``applyInPandas`` run.
    """
    sc = spark.sparkContext
    if getattr(sc, "_talentgrid_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="talentgrid-ship-"), "talentgrid_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._talentgrid_shipped = True
    return spark
