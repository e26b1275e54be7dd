"""Checkpoint folder rules: the cluster's shared folder is used when set; a
scratch folder is only made in local mode; a cluster without the setting is
refused rather than given a machine-local folder."""

from __future__ import annotations

import pytest

from orderlytics.session import ensure_checkpoint_dir


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class _Context:
    def __init__(self, master, configured=None):
        self.master, self._conf, self.dir = master, _Conf(configured), None

    def getCheckpointDir(self):
        return self.dir

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, path):
        self.dir = path


class _Session:
    def __init__(self, master, configured=None):
        self.sparkContext = _Context(master, configured)


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session("yarn"))


def test_configured_shared_folder_is_used():
    s = _Session("k8s://cluster", "hdfs://shared/checkpoints")
    assert ensure_checkpoint_dir(s) == "hdfs://shared/checkpoints"
    assert s.sparkContext.dir == "hdfs://shared/checkpoints"


def test_local_mode_gets_a_scratch_folder():
    s = _Session("local[2]")
    assert ensure_checkpoint_dir(s).startswith("/")


def test_live_session_has_a_folder(spark):
    assert ensure_checkpoint_dir(spark)
