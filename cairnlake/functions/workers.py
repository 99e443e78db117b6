"""Python workers must find this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def let_workers_import(spark: SparkSession) -> None:
    """Add the folder of this package to the workers' path, for sessions whose own path lacks it.

    On a cluster the package is installed or shipped (--py-files); the folder is then unknown
    to the executors, which skip it.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
