"""Python workers have to find this package as the driver does."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reach_workers(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path; where it isn't at the same place, it has to be installed."""
    root, env = str(Path(__file__).parents[1]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))
