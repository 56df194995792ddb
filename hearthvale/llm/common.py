"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthvale.session import checkpoint_dir
from hearthvale.session import ship_package as ship  # noqa: F401  one archive of this name in a session, as two may differ

# Small frames (per-partition totals, manifests) are broadcast up to this many
# rows; beyond it the join is left to the planner.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start
    from files, so a lost executor never replays the work before them."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a frame whose row count is known to be ``rows``."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
