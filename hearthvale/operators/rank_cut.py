"""The value at a rank position (``ROWNUM = CEIL(N * p)`` over an
ascending sort, NULLs last, N counting NULL rows) without sorting the rows.

A mergeable quantile sketch (``approx_percentile``) names two values that
enclose the position; one exact count of what lies below, on and between them
says on which of the three it falls. On one of the values, the answer is found;
between them, the same is done with what lies between, about
``4 / ACCURACY`` of the rows, until at most ``FEW`` rows are left, which are
sorted. Every step is a map-side combined aggregate of a few numbers: neither
the rows nor a histogram of them is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000      # of the sketch: its ranks are off by N / ACCURACY at most
FEW = 4_096


def value_at_rank(df: DataFrame, col: str, num: int, den: int, accuracy: int = ACCURACY, few: int = FEW) -> DataFrame:
    """One row ``cut``: the value at position ``ceil(N * num / den)``.

    ``num/den`` is the fraction as an exact ratio (0.97 -> 97/100), and the
    position is computed in integers: ``(num*N + den - 1) div den``. The cut
    is NULL when the position lies among the NULLs or N = 0.
    """
    spark, kind = df.sparkSession, df.schema[col].dataType
    v = F.col("v")
    rows = df.select(F.col(col).alias("v"))
    n, inside = rows.agg(F.count(F.lit(1)), F.count("v")).first()
    at = (num * n + den - 1) // den                  # from 1, among the rows still in play
    rows = rows.filter(v.isNotNull())

    def answer(value) -> DataFrame:
        return spark.range(1).select(F.lit(value).cast(kind).alias("cut"))

    if not 0 < at <= inside:
        return answer(None)
    while inside > few:
        share, off = at / inside, 2 / accuracy
        ends = [min(1.0, max(0.0, share - off)), min(1.0, max(0.0, share + off))]
        low, high = rows.agg(F.percentile_approx("v", ends, accuracy)).first()[0]
        low, high = F.lit(low).cast(kind), F.lit(high).cast(kind)
        parts = [v < low, v == low, (v > low) & (v < high), (v == high) & (low < high), v > high]
        counts = rows.agg(*[F.count(F.when(p, 1)) for p in parts]).first()
        for part, here in zip(parts, counts):
            if at <= here:
                break
            at -= here
        if part is parts[1] or part is parts[3]:
            return rows.filter(part).agg(F.min("v").alias("cut"))
        rows, inside = rows.filter(part), here
    return rows.orderBy("v").limit(at).agg(F.max("v").alias("cut"))     # at most ``few`` rows
