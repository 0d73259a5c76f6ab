import pytest

from loomtrace.sources import shared


class Cluster:
    """As much of a session as finding the shared folder takes."""

    def __init__(self, master, folder=None):
        self.conf, self.master, self.applicationId = self, master, "app-1"
        self.sparkContext, self.found = self, {}
        self.getConf = lambda: {"spark.checkpoint.dir": folder}
        self.getCheckpointDir = lambda: None

    def get(self, key, default=None):
        return self.found.get(key, default)

    def set(self, key, value):
        self.found[key] = value


def test_the_shared_folder(spark):
    assert shared.job_folder(Cluster("spark://a:7077", "hdfs://b/c/")) == "hdfs://b/c/loomtrace/app-1"
    assert shared.job_folder(Cluster("spark://a:7077", "file:/b/c")) == "file:///b/c/loomtrace/app-1"
    with pytest.raises(ValueError, match="share"):
        shared.job_folder(Cluster("spark://a:7077"))
    here = Cluster("local[2]")
    assert shared.job_folder(here).startswith("file://") and shared.job_folder(here) == shared.job_folder(here)
    assert shared.qualified(spark, "/b/c/") == "file:///b/c"
