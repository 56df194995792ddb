"""Connected components by contraction.

Each round every node points to the neighbour (or itself) of the smallest
random priority; the graph of those targets keeps the components and has a
constant fraction fewer nodes, so the rounds grow with the logarithm of the
number of nodes whatever the shape (a plain minimum would take a round per
link on a path). Edges and labels are written to the shared folder after each
round. A node of very high degree is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthvale.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """``edges``: long columns ``a, b``, neither null. Gives ``node, root``:
    the same root for all nodes of a component (an arbitrary member)."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    left = staged(both.filter("a <> b").distinct(), "links")
    labels = staged(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    turn = 0
    while not left.isEmpty():
        def rank(c: str):
            return F.struct(F.xxhash64(F.lit(turn), c).alias("p"), F.col(c).alias("v"))

        to = (left.groupBy("a").agg(F.min(rank("b")).alias("m"))
              .select(F.col("a").alias("v"), F.least("m", rank("a"))["v"].alias("t")))
        to = staged(to, "targets")
        labels = staged(labels.join(to, labels["root"] == to["v"], "left")
                        .select("node", F.coalesce("t", "root").alias("root")), "labels")
        a, b = to.select(F.col("v").alias("a"), F.col("t").alias("ta")), to.select(F.col("v").alias("b"), F.col("t").alias("tb"))
        left = staged(left.join(a, "a").join(b, "b").filter("ta <> tb")
                      .select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "links")
        turn += 1
    return labels
