"""M9 — upsert by key on a snapshot that has no MERGE (plain Parquet).

Deltas are aggregated per key first (map-side combined), so the join sees
one delta row per key whatever the batch skew; the snapshot is then joined
once (full outer for ``MERGE``, left for ``UPDATE``-only) and rewritten as a
new version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_poisoned_sum(c: str) -> Column:
    """Σ that is NULL as soon as one term is NULL (a row-by-row
    ``q = q + amount`` fold: one NULL amount makes the quantity NULL)."""
    return F.when(F.count(F.col(c)) == F.count(F.lit(1)), F.sum(c))


def fold_deltas(deltas: DataFrame, keys: Sequence[str], amount: str, out: str = "delta") -> DataFrame:
    return deltas.groupBy(*keys).agg(null_poisoned_sum(amount).alias(out))


def merge_add(snapshot: DataFrame, deltas: DataFrame, keys: Sequence[str], qty: str, amount: str) -> DataFrame:
    """``MERGE``: matched -> ``qty + Σamount``; not matched -> insert ``Σamount``."""
    d = fold_deltas(deltas, keys, amount)
    new_q = (F.when(F.col("__in_snap").isNull(), F.col("delta"))
             .when(F.col("__in_delta").isNull(), F.col(qty))
             .otherwise(F.col(qty) + F.col("delta")))
    j = (snapshot.withColumn("__in_snap", F.lit(1))
         .join(d.withColumn("__in_delta", F.lit(1)), list(keys), "full_outer"))
    return j.select(*keys, new_q.cast(snapshot.schema[qty].dataType).alias(qty))


def update_add(snapshot: DataFrame, deltas: DataFrame, keys: Sequence[str], qty: str, amount: str,
               sign: int = 1) -> DataFrame:
    """``UPDATE ... SET qty = qty ± Σamount WHERE key matches``: rows without
    a snapshot match are ignored; untouched rows keep their quantity."""
    d = fold_deltas(deltas, keys, amount)
    j = snapshot.join(d.withColumn("__hit", F.lit(1)), list(keys), "left")
    new_q = F.when(F.col("__hit").isNull(), F.col(qty)).otherwise(F.col(qty) + F.lit(sign) * F.col("delta"))
    return j.select(*keys, new_q.cast(snapshot.schema[qty].dataType).alias(qty))
