"""Top-1 / arg-max building blocks.

Ties are kept in one pass: ``rank() <= 1`` becomes a ``WindowGroupLimit`` that
runs before the shuffle, so a map task sends the rows tied for its best alone
and the input is evaluated once. Highest and lowest together (no single rank)
are found per (group, salt) first, so that a group that holds a third of all rows
is spread over ``SALTS`` tasks, then among what is left. The only broadcasts are
of one-row results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def top1_by(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One row, the first under ``order`` (``TakeOrderedAndProject``)."""
    return df.orderBy(*order).limit(1)


def _best(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    turn = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__rank", F.rank().over(turn)).filter(F.col("__rank") <= 1).drop("__rank")


def all_ties_max(df: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` equals the global maximum (ties kept). NULLs never
    qualify. Best rows per salt first, so the last step sees few."""
    rows = df.filter(F.col(col).isNotNull()).withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    best = _best(rows, ["__salt"], F.col(col).desc()).withColumn("__all", F.lit(0))
    return _best(best, ["__all"], F.col(col).desc()).drop("__salt", "__all")


def rank1_per_group(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """``RANK() OVER (PARTITION BY keys ORDER BY col DESC) = 1``.

    Oracle sorts NULLs first in a descending order, so a group whose values
    include NULL ranks its NULL rows first; otherwise the rows equal to the
    group maximum win.
    """
    return _best(df, keys, F.col(col).desc_nulls_first())


def extremes_per_group(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Rows whose ``col`` is the group's highest or lowest, each once, with
    ``__high`` and ``__low``. NULLs never qualify."""
    def cut(rows: DataFrame, by: list[str]) -> DataFrame:
        group = Window.partitionBy(*by)
        rows = rows.withColumn("__high", F.max(col).over(group)).withColumn("__low", F.min(col).over(group))
        return rows.filter((F.col(col) == F.col("__high")) | (F.col(col) == F.col("__low")))

    rows = df.filter(F.col(col).isNotNull()).withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    some = cut(rows, [*keys, "__salt"]).drop("__high", "__low", "__salt")
    return cut(some, list(keys))


def best_row_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[Column, bool, bool]],
                       payload: Sequence[str]) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY ...) = 1``.

    ``order`` is a list of ``(expr, descending, nulls_first)``. The ordering
    is encoded into a struct whose natural ``max`` is the first row, so the
    choice is a plain aggregate (partial on the map side): for each term a
    null-rank flag, then the value (negated for ascending numerics).
    """
    fields = []
    for i, (expr, desc, nulls_first) in enumerate(order):
        # max() prefers the larger flag: 1 for the side that must come first
        flag = expr.isNull() if nulls_first else expr.isNotNull()
        fields.append(flag.cast("int").alias(f"__f{i}"))
        fields.append((expr if desc else -expr).alias(f"__v{i}"))
    for c in payload:
        fields.append(F.col(c).alias(c))
    best = df.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in payload])
