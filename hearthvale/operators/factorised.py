"""A product of two tables kept as its factors.

A join on a constant predicate pairs every row of one table with every row of
another. Its rows are all known from the two factors, so nothing is gained by
writing them: counts, totals per key, membership, primary-key and foreign-key
checks are computed from the factors, in work that grows with their sum.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WIDE = "decimal(38,0)"       # a product of two counts may pass 63 bits


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).cast(_WIDE)).scalar()


@dataclass(frozen=True)
class Product:
    """Every row of ``left`` with every row of ``right``; no column in common."""

    left: DataFrame
    right: DataFrame

    def one_row(self) -> DataFrame:
        return self.left.sparkSession.range(1).select(F.lit(1).alias("one"))

    def rows(self) -> Column:
        """The exact number of rows."""
        return _count(self.left) * _count(self.right)

    def totals(self, *keys: str) -> DataFrame:
        """Rows per value of ``keys``, all of one factor: ``keys, n_rows``."""
        mine, other = (self.left, self.right) if set(keys) <= set(self.left.columns) else (self.right, self.left)
        per = mine.groupBy(*keys).agg(F.count(F.lit(1)).cast(_WIDE).alias("here"))
        return per.select(*keys, (F.col("here") * _count(other)).alias("n_rows")).filter("n_rows > 0")

    def holds(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` (columns of both factors) that are in the product."""
        out = rows
        for side in (self.left, self.right):
            named = [c for c in rows.columns if c in side.columns]
            if named:
                out = out.join(side.select(*named).distinct(), named, "left_semi")
        return out

    def repeated_keys(self, key: Sequence[str]) -> Column:
        """Values of ``key`` that occur more than once (a null in it counts none)."""
        once, every = [], []
        for side in (self.left, self.right):
            cols = [c for c in key if c in side.columns]
            whole = side.dropna(subset=cols) if cols else side
            per = whole.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")) if cols else whole.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
            every.append(_count(per))
            once.append(_count(per.filter("n = 1")))
        return every[0] * every[1] - once[0] * once[1]

    def orphans(self, column: str, parent: DataFrame, parent_column: str) -> Column:
        """Rows whose non-null ``column`` is no key of ``parent``."""
        mine, other = (self.left, self.right) if column in self.left.columns else (self.right, self.left)
        lost = mine.filter(F.col(column).isNotNull()).join(
            parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")
        return _count(lost) * _count(other)
