"""J12 at scale: the k unordered pairs whose value sum is closest to a target.

The reference enumerates every pair (``f1.id < f2.id``), a nested loop join.
Here the work is linear in the number of distinct values:

1. Per value: its two smallest ids (map-side aggregates), and through
   ``per_value_reduction`` its ``k + 1`` smallest ids.
2. The distinct values are ranked (range partitions, running sums, one offset
   per partition), and so are their complements ``T - v`` among them.
3. Each value meets the ``k + 1`` values on either side of its complement, by
   an equality join on ranks: at most ``2 (k + 1)`` candidates per value. A
   value farther away has ``k`` strictly closer partners before it, even if
   one of them is the value itself.
4. The k best value pairs by (distance, smallest id pair) are enough: any pair
   of ids sorts after the smallest one of its values, so the values of the k
   best id pairs are among them. Only those are expanded to ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthvale.session import checkpoint_dir


def per_value_reduction(df: DataFrame, id_col: str, val_col: str, k: int) -> DataFrame:
    """The ``k+1`` smallest ids of every non-NULL value (``id, v``): a partial
    ``WindowGroupLimit``, so a hot value ships ``k+1`` rows per map task."""
    base = df.select(F.col(id_col).alias("id"), F.col(val_col).alias("v")).filter(F.col("v").isNotNull())
    rn = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return base.withColumn("rn", rn).filter(F.col("rn") <= k + 1).drop("rn")


def ranked_with_complements(values: DataFrame, target: float) -> DataFrame:
    """``v, own, rank`` over all values (``own``: rank of ``v`` from 1) and
    their complements (not ``own``: number of values below ``T - v``)."""
    spark = values.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = values.select(F.col("v").cast("double").alias("x"), F.lit(1).alias("own"), "v").unionByName(
        values.select((F.lit(float(target)) - F.col("v").cast("double")).alias("x"), F.lit(0).alias("own"), "v"))
    dealt = (both.repartitionByRange(n, "x", "own", "v").withColumn("part", F.spark_partition_id())
             .checkpoint(eager=True))          # fixes every row's partition
    counts = dealt.groupBy("part").agg(F.sum("own").alias("n"))
    offsets = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("low"))   # a row per partition
    run = F.sum("own").over(Window.partitionBy("part").orderBy("x", "own", "v").rowsBetween(Window.unboundedPreceding, 0))
    return (dealt.withColumn("run", run).join(F.broadcast(offsets), "part")
            .select("v", (F.col("own") == 1).alias("own"), (F.col("low") + F.col("run")).cast("bigint").alias("rank")))


def candidate_values(values: DataFrame, target: float, k: int) -> DataFrame:
    """Value pairs ``u <= w`` that can hold one of the k closest id pairs: at
    most ``2 (k + 1)`` per value."""
    ranked = ranked_with_complements(values, target)
    near = ranked.filter("not own").select(
        F.col("v").alias("a"), F.explode(F.sequence(F.col("rank") - k, F.col("rank") + k + 1)).alias("rank"))
    met = near.join(ranked.filter("own").select(F.col("v").alias("b"), "rank"), "rank")
    return met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("w")).distinct()


def closest_pair_sums(df: DataFrame, id_col: str, val_col: str, target: float, k: int) -> DataFrame:
    """Top-``k`` pairs ``(id1 < id2)`` by ``|v1 + v2 - target|``, then ids.

    Returns ``id1, id2, v1, v2, dist``. Rows with a NULL value are ignored.
    """
    red = per_value_reduction(df, id_col, val_col, k)
    checkpoint_dir(df.sparkSession)
    red = red.checkpoint(eager=True)           # at most k + 1 rows per distinct value, read three times
    ids = red.groupBy("v").agg(F.min("id").alias("m1"), F.sort_array(F.collect_list("id")).alias("ids"))
    ids = ids.select("v", "m1", F.get("ids", F.lit(1)).alias("m2"))
    dist = F.abs(F.col("u") + F.col("w") - F.lit(target))
    pairs = (candidate_values(ids.select("v"), target, k)
             .join(ids.select(F.col("v").alias("u"), F.col("m1").alias("a1"), F.col("m2").alias("a2")), "u")
             .join(ids.select(F.col("v").alias("w"), F.col("m1").alias("b1")), "w"))
    other = F.when(F.col("u") == F.col("w"), F.col("a2")).otherwise(F.col("b1"))
    best = (pairs.withColumn("other", other).filter("other is not null")
            .select("u", "w", dist.alias("dist"), F.least("a1", "other").alias("lo"), F.greatest("a1", "other").alias("hi"))
            .orderBy("dist", "lo", "hi").limit(k))
    one, two = red.select(F.col("id").alias("ia"), F.col("v").alias("u")), red.select(F.col("id").alias("ib"), F.col("v").alias("w"))
    rows = best.select("u", "w", "dist").join(one, "u").join(two, "w")              # (k + 1)^2 rows for each of k
    rows = rows.filter(((F.col("u") != F.col("w")) & (F.col("ia") != F.col("ib"))) | (F.col("ia") < F.col("ib")))
    first = F.col("ia") < F.col("ib")
    return (rows.select(F.least("ia", "ib").alias("id1"), F.greatest("ia", "ib").alias("id2"),
                        F.when(first, F.col("u")).otherwise(F.col("w")).alias("v1"),
                        F.when(first, F.col("w")).otherwise(F.col("u")).alias("v2"), "dist")
            .orderBy(F.col("dist").asc(), F.col("id1").asc(), F.col("id2").asc()).limit(k))
