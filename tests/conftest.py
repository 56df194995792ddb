from __future__ import annotations

import os
import sys
import tempfile
from types import SimpleNamespace

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from hearthvale.session import get_session

    s = get_session("local[*]", 8, app_name="hearthvale-tests")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hv-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def tmpdir_run():
    return tempfile.mkdtemp(prefix="hv-run-")


def domain(spark, **tables):
    """A stand-in Domain: named DataFrames built from row lists + DDL schemas."""
    out = {}
    for name, (rows, ddl) in tables.items():
        out[name] = spark.createDataFrame(rows, ddl)
    return SimpleNamespace(**out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())
