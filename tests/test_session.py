"""Checkpoint folder handling."""

import pytest

from gapseries.session import cut_lineage, ensure_checkpoint_dir


def test_checkpoint_dir_comes_from_the_session(spark):
    current = spark.sparkContext.getCheckpointDir()
    assert current
    assert ensure_checkpoint_dir(spark) == current  # never overridden
    df = cut_lineage(spark.range(5))
    assert df.count() == 5


class _Context:
    def __init__(self, master):
        self.master, self.set = master, None

    def getCheckpointDir(self):
        return self.set

    def setCheckpointDir(self, path):
        self.set = path


class _Session:
    """A session without a checkpoint folder."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.folder = _Context(master), folder
        self.conf = self

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session(master))
    assert ensure_checkpoint_dir(_Session(master, "hdfs:///shared")) == "hdfs:///shared"


def test_a_local_session_gets_a_folder_of_its_own():
    assert ensure_checkpoint_dir(_Session("local[2]"))
