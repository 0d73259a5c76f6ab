"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def job_folder(spark: SparkSession) -> str:
    """This application's own folder under spark.checkpoint.dir, as a URI. Where that is unset, a temporary one, if all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomtrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{qualified(spark, found)}/loomtrace/{spark.sparkContext.applicationId}"


def qualified(spark: SparkSession, path: str) -> str:
    """A folder as a URI that readers in Python and Spark's own take for the same place: a bare path is of Spark's default file system."""
    if ":" not in path.partition("/")[0]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return path.rstrip("/")
