from __future__ import annotations

import os

import pytest

from postlake import session


def path_of(df):
    return df.scratch.removeprefix("file:")


def test_intermediates_can_be_deleted(spark):
    a = session.materialise(spark.range(5), "a")
    b = session.materialise(spark.range(6), "b")
    assert a.count() == 5 and os.path.isdir(path_of(a))
    session.discard(a)
    assert not os.path.exists(path_of(a)) and b.count() == 6
    session.release(spark)
    assert not os.path.exists(path_of(b))
    session.release(spark)


class Context:
    def __init__(self, master):
        self.master = master
        self.applicationId = master


class Session:
    """As much of a session as the folder's choice looks at."""

    def __init__(self, master, folder):
        self.sparkContext = Context(master)
        self.conf = self
        self.folder = folder

    def get(self, key, default):
        return self.folder

    def set(self, key, value):
        self.folder = value


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_cluster_needs_a_shared_folder(master):
    for folder in (None, "/tmp", "file:///tmp/"):
        with pytest.raises(RuntimeError):
            session.shared_folder(Session(master, folder))
    assert session.shared_folder(Session(master, "hdfs:///scratch/")) == "hdfs:///scratch"


def test_one_machine_falls_back_to_a_temporary_folder():
    own = Session("local[2]", None)
    assert session.shared_folder(own) == own.folder
