"""Change feed from two versions of a keyed table (the rows an update trigger
would see): inserted, deleted and updated keys with their old and new values.

A row is reduced to its key and a 128-bit hash of the compared columns; one
aggregate over both versions finds the keys whose hashes differ, so the wide
columns of unchanged rows are never shuffled. Old and new values are then joined
to the changed keys alone. Null and a value are different; null and null are
not. Keys may hold nulls and must be unique within a version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fingerprint(cols: Sequence[str]) -> Column:
    # each value with a null flag, so (null, 'a') and ('a', null) differ
    parts = [p for c in cols for p in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *reversed(parts)).alias("b"))


def row_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``keys, kind`` (insert, delete, update), ``old_<c>`` and ``new_<c>`` for
    the keys of which any of ``cols`` differs between the versions."""
    keys, cols = list(keys), list(cols)
    both = old.select(*keys, _fingerprint(cols).alias("was"), F.lit(None).cast("struct<a: bigint, b: bigint>").alias("now")).unionByName(
        new.select(*keys, F.lit(None).cast("struct<a: bigint, b: bigint>").alias("was"), _fingerprint(cols).alias("now")))
    hit = both.groupBy(*keys).agg(F.max("was").alias("was"), F.max("now").alias("now")).filter(~F.col("was").eqNullSafe(F.col("now")))
    kind = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").otherwise("update")
    hit = hit.select(*[F.col(k).alias(f"__{k}") for k in keys], kind.alias("kind"))

    def values(side: DataFrame, name: str) -> DataFrame:
        return side.select(*[F.col(k).alias(f"__{name}_{k}") for k in keys], *[F.col(c).alias(f"{name}_{c}") for c in cols])

    out = hit
    for side, name in ((old, "old"), (new, "new")):
        same = [F.col(f"__{k}").eqNullSafe(F.col(f"__{name}_{k}")) for k in keys]
        cond = same[0]
        for c in same[1:]:
            cond = cond & c
        out = out.join(values(side, name), cond, "left")
    return out.select(*[F.col(f"__{k}").alias(k) for k in keys], "kind", *[F.col(f"old_{c}") for c in cols], *[F.col(f"new_{c}") for c in cols])
