"""Every registered entry vs its DuckDB oracle on the smallest supplied
tables (the driver repeats this at sf0.01)."""

from __future__ import annotations

import collections
import os

import duckdb
import pytest

import __spark_entry__ as E
from hearthvale.registry import entries
from hearthvale.sources.testdata import TABLES

SF = os.environ.get("HV_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


QUERIES = {name: fn for name, (fn, _sql) in entries().items()}     # tests/llm covers the others
ORACLE = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_entry_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        pytest.skip("no SQL oracle (rows-only)")
    res = con.execute(ORACLE[name])
    ocols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(ocols)
    idx = [ocols.index(c) for c in df.columns]
    want = [tuple(r[i] for i in idx) for r in res.fetchall()]
    assert collections.Counter(got) == collections.Counter(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["store_name", "specialization", "item_name", "num_purchases"]
    assert df.count() >= 0
