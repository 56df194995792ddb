"""Scan of the supplied Parquet tables.

Every read is a lazy ``spark.read.parquet``: Catalyst prunes columns and
pushes filters into the scan, so callers simply select what they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


_SCHEMAS: dict[str, object] = {}


class TestTables:
    """Accessor for ``<sf_dir>/<name>.parquet``; one DataFrame per name.

    The Parquet footer is read once per path and process; later reads pass
    the schema explicitly (no per-query schema inference on the driver).
    """

    __test__ = False  # not a pytest class

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._dfs: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._dfs:
            p = self.path(name)
            if p in _SCHEMAS:
                df = self.spark.read.schema(_SCHEMAS[p]).parquet(p)
            else:
                df = self.spark.read.parquet(p)
                _SCHEMAS[p] = df.schema
            self._dfs[name] = df
        return self._dfs[name]
