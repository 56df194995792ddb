"""The shared folder comes from the session; ours is only a fallback."""

from __future__ import annotations

import pytest

from hearthvale.session import checkpoint_dir


def test_checkpoint_dir_is_read_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert checkpoint_dir(spark) == (configured or spark.sparkContext.getCheckpointDir())
    assert spark.sparkContext.getCheckpointDir() is not None


class _Unset:
    """A local session in which nobody named a folder."""

    def __init__(self, master):
        self.conf, self.sparkContext, self.master, self.dir = self, self, master, None

    def get(self, key, default=None):
        return default

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


def test_checkpoint_dir_without_a_setting():
    local = _Unset("local[2]")
    assert checkpoint_dir(local) and checkpoint_dir(local) == local.dir
    with pytest.raises(RuntimeError):
        checkpoint_dir(_Unset("spark://somewhere:7077"))
