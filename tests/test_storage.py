"""Tables in the shared folder."""

import os

import pytest

from heronlake.sources import storage


def path_of(df):
    return df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")


def test_scratch_deletes_what_is_left_in_it(spark):
    with storage.scratch(spark) as paths:
        kept = storage.store(spark.range(3), "kept")
        paths.pop()
        gone = path_of(storage.store(spark.range(3), "gone"))
        assert os.path.exists(gone)
    assert kept.count() == 3 and not os.path.exists(gone)
    storage.forget(kept)


class Session:
    """A session of a cluster without the setting."""

    def __init__(self, master, folder=None):
        self.conf, self.sparkContext = self, self
        self.master, self.folder = master, folder

    def get(self, name, default=None):
        return default

    def getCheckpointDir(self):
        return self.folder


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        storage.shared_dir(Session("spark://host:7077"))
    assert storage.shared_dir(Session("spark://host:7077", "hdfs://name/checks/")) == "hdfs://name/checks"
