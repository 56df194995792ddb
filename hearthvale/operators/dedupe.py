"""M2 / W1 — first row per key in arrival order, and M1 idempotent append.

``ROW_NUMBER() OVER (PARTITION BY k ORDER BY ROWNUM) = 1`` becomes a
``min_by(struct(row), ingest_seq)`` aggregate: partial aggregation on the
map side, no sort, and a key holding a third of all rows is reduced to one
row per map task before the shuffle.

Three variants the reference mixes, kept apart:

* ``"before"`` — completeness filter first, then numbering: the first
  *complete* row of a key wins.
* ``"after"`` — numbering first, then the filter: a key whose first row is
  incomplete disappears.
* ``"none"`` — the first row is kept with its NULLs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(cols: Sequence[str]) -> Column:
    """All of ``cols`` are non-NULL."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def first_row_per_key(df: DataFrame, keys: Sequence[str], order: str,
                      required: Sequence[str] = (), variant: str = "before") -> DataFrame:
    """Keep the row with the smallest ``order`` value per ``keys``."""
    if variant not in ("before", "after", "none"):
        raise ValueError(variant)
    src = df.filter(complete(required)) if (variant == "before" and required) else df
    others = [c for c in df.columns if c not in keys]
    first = (src.groupBy(*keys)
             .agg(F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order)).alias("__r"))
             .select(*keys, *[F.col(f"__r.{c}").alias(c) for c in others]))
    if variant == "after" and required:
        first = first.filter(complete(required))
    return first.select(*df.columns)


def append_new(new: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M1 ``INSERT ... WHERE NOT EXISTS (target row with the same key)``.

    Returns the rows to append. Like the SQL, duplicates inside ``new``
    are *not* removed (combine with ``first_row_per_key`` for that).
    """
    return new.join(target.select(*keys).filter(complete(keys)), list(keys), "left_anti")
