import pytest

from gridmill.session import shared_folder


class Context:
    def __init__(self, master):
        self.master = master
        self.folder = None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, setting=None):
        self.sparkContext = Context(master)
        self.conf = {"spark.checkpoint.dir": setting}


def test_the_named_folder_is_used(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(Session("yarn", "hdfs://shared/cut/")) == "hdfs://shared/cut"


def test_a_local_folder_only_in_local_mode():
    session = Session("local[2]")
    assert shared_folder(session) == shared_folder(session)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session("spark://host:7077"))
