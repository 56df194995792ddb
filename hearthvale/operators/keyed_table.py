"""Keyed tables that are updated in place of being rewritten (S3, M8, M9).

A table is partitioned by a bucket of its key, ``pmod(xxhash64(key), buckets)``.
An update finds the buckets its changes fall into, reads those alone (a
partition filter) and writes those alone (dynamic partition overwrite); the
other files stay as they are. Its new rows are written apart first, so what is
read is never what is being replaced, and a run that broke off can be repeated:
updates are functions of the old rows and the changes, and the ones here
(``fill_missing``, ``replace_rows``) change nothing when repeated.

One writer at a time; a bucket's files are replaced when the job commits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthvale.session import staged

BUCKET = "key_bucket"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Write ``df`` as a keyed table at ``path`` (which must not exist)."""
    (df.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(F.col(BUCKET))
     .write.mode("errorifexists").partitionBy(BUCKET).parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def rows_of(spark: SparkSession, path: str, touched: Sequence[int]) -> DataFrame:
    """The rows of some buckets: only their folders are listed in the scan."""
    return spark.read.parquet(path).filter(F.col(BUCKET).isin([int(b) for b in touched]))


def update(spark: SparkSession, path: str, keys: Sequence[str], buckets: int, changes: DataFrame,
           apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Replace the buckets that ``changes`` (which has ``keys``) falls into by
    ``apply(their rows, changes)``. Gives those buckets, at most ``buckets``."""
    changes = staged(changes, "keyed-changes")
    touched = sorted(r[0] for r in changes.select(bucket_of(keys, buckets)).distinct().collect())
    if touched:
        now = rows_of(spark, path, touched).drop(BUCKET)
        new = staged(apply(now, changes).select(*now.columns), "keyed-rows").withColumn(BUCKET, bucket_of(keys, buckets))
        (new.repartition(F.col(BUCKET)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET).parquet(path))
    return touched


def fill_missing(spark: SparkSession, path: str, keys: Sequence[str], buckets: int, column: str, candidates: DataFrame,
                 value: str) -> list[int]:
    """M8: ``column`` of the rows that lack it becomes the least ``value`` among
    the candidates of their key, if there is any. Only buckets with a row to fill
    are read and written; a second run fills nothing and writes nothing."""
    keys = list(keys)
    lacking = spark.read.parquet(path).filter(F.col(column).isNull()).select(*keys)
    first = candidates.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("__fill"))
    return update(spark, path, keys, buckets, first.join(lacking, keys, "left_semi"),
                  lambda now, fill: now.join(fill, keys, "left").withColumn(column, F.coalesce(column, "__fill")))


def replace_rows(spark: SparkSession, path: str, keys: Sequence[str], buckets: int, rows: DataFrame) -> list[int]:
    """M9 by whole rows: those of known keys are replaced, others added. ``rows``
    has one row per key and the table's columns."""
    keys = list(keys)
    return update(spark, path, keys, buckets, rows,
                  lambda now, new: now.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*now.columns)))
