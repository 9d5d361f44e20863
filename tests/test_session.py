"""Shared-folder rules: the cluster's setting wins; no private folder on a cluster."""

import pytest

from transcript_lake.session import new_table_path, shared_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, conf):
        self.master = master
        self.applicationId = "app-1"
        self._conf = _Conf(conf)
        self.checkpoint = None

    def getConf(self):
        return self._conf

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, d):
        self.checkpoint = d


class _Session:
    def __init__(self, master, conf=None):
        self.conf = _Conf(conf or {})
        self.sparkContext = _Context(master, conf or {})


def test_cluster_setting_is_used():
    s = _Session("yarn", {"spark.checkpoint.dir": "s3a://bucket/shared"})
    assert shared_dir(s) == "s3a://bucket/shared"
    assert new_table_path(s, "t").startswith("s3a://bucket/shared/tables/t-")


def test_no_private_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session("spark://master:7077"))


def test_local_runs_get_one_private_folder():
    s = _Session("local[2]")
    first = shared_dir(s)
    assert shared_dir(s) == first
    assert s.sparkContext.getCheckpointDir().startswith(first)
