"""Merkle manifest of a dataset: one tree per group, one root over the groups.

Every row is a leaf: the digest of its fields. Leaves of a group stand in
ascending key order and are numbered without a window over a whole group (range
partitions, their counts, offsets). A phase then climbs ``LEVELS`` levels in
aligned blocks of ``2 ** LEVELS`` numbers, all in one shuffle: at level ``l`` a
node lives on the row of its first leaf; ``lead`` and ``lag`` by the fixed offset
``2 ** l``, masked by the node's slot and by the length of the run, give its
sibling, and the rows of first children hash the parents. The block's top nodes
are the rows of the next phase, so phase ``p`` works on a ``2 ** (LEVELS p)``-th
of the leaves. Group roots climb the same way to the dataset's root. Paths of
siblings then come down by joins on the block, one per phase.

Digests are lowercase hex sha256 over the concatenated inputs, inner ones over
hex text; two consecutive nodes make one, a last single one is hashed alone.

Edge cases: a null field is ``-``, any other its UTF-8 length, ``:`` and its
value, so null and empty differ; a null group is a group of its own and the
first; a null key comes first; rows of equal keys stand in the order of their
leaves, then of the scan, and repeated rows are leaves of their own; a lone leaf
is its group's root, and a lone group's root the dataset's; an empty table gives
no rows. Input columns are read before any helper column is made, so columns of
any name are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthvale.llm.common import staged

LEVELS = 8        # levels climbed in one phase; a block has 2 ** LEVELS rows
_PATH = "array<struct<left: boolean, sib: binary>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def leaf_of(fields: list[Column]) -> Column:
    """Digest of a row's fields."""
    def coded(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return digest(*map(coded, fields))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``idx`` (from 0, gapless in ``g`` by ``order``) and ``n``, the rows of ``g``."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(parts, "g", *order).withColumn("part", F.spark_partition_id()), "merkle-order")
    runs = dealt.groupBy("g", "part").agg(F.count(F.lit(1)).alias("here"))      # at most partitions + groups rows
    before = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("g", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("at"),
                       F.sum("here").over(W.partitionBy("g")).alias("n"))
    local = F.row_number().over(W.partitionBy("part", "g").orderBy(*order))
    return (dealt.withColumn("local", local).join(runs, ["g", "part"])
            .withColumn("idx", F.col("at") + F.col("local") - 1).drop("part", "local", "at"))


def _climbed(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (``g, n, idx, h, ...``) with the node's ``path`` of siblings up to
    the top of its block, and ``top``, the block's node, on the block's first row."""
    idx, n = F.col("idx"), F.col("n")
    block = W.partitionBy("g", "block").orderBy("idx")
    out = nodes.withColumn("block", F.shiftright("idx", levels)).withColumn("h0", F.col("h"))
    for l in range(levels):
        size = 1 << l
        mine, alone = F.col(f"h{l}"), F.lit("")
        left = idx.bitwiseAND(F.lit(size)) != 0
        is_node = (idx.bitwiseAND(F.lit(size - 1)) == 0) & (n > size)           # else one node is left: no more levels
        out = (out.withColumn("right", F.lead(mine, size).over(block)).withColumn("lag", F.lag(mine, size).over(block))
               .withColumn(f"s{l}", F.when(is_node, F.struct(F.unhex(F.when(left, F.col("lag")).otherwise(F.col("right"))).alias("sib"))))
               .withColumn(f"h{l + 1}", F.when(idx.bitwiseAND(F.lit(2 * size - 1)) == 0, F.when(
                   n > size, digest(mine, F.coalesce("right", alone))).otherwise(mine))))
    filled = block.rowsBetween(W.unboundedPreceding, W.currentRow)             # the last first row before: the node's
    siblings = [F.last(f"s{l}", ignorenulls=True).over(filled) for l in range(levels)]
    out = out.select(*nodes.columns, "block", F.col(f"h{levels}").alias("top"), *[s.alias(f"p{l}") for l, s in enumerate(siblings)])
    steps = F.array(*[F.struct((idx.bitwiseAND(F.lit(1 << l)) != 0).alias("left"), F.col(f"p{l}.sib").alias("sib")) for l in range(levels)])
    active = sum((F.when(n > (1 << l), 1).otherwise(0) for l in range(levels)), F.lit(0))
    return out.select(*nodes.columns, "block", "top", F.slice(steps, F.lit(1), active).cast(_PATH).alias("path"))


def _trees(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (``g, n, idx, h, ...``) with their whole ``path`` and their tree's
    root ``up``; and the roots, ``g, h``."""
    phases, deep = [], nodes.agg(F.max("n")).first()[0]
    while not phases or deep > 1:
        phases.append(staged(_climbed(nodes, levels), "merkle-phase"))
        nodes = phases[-1].filter(F.col("top").isNotNull()).select(
            "g", F.ceil(F.col("n") / (1 << levels)).cast("long").alias("n"), F.col("block").alias("idx"), F.col("top").alias("h"))
        deep = -(-deep // (1 << levels))
    roots = nodes.select("g", "h")
    down = roots.select("g", F.lit(0).cast("long").alias("block"), F.array().cast(_PATH).alias("rest"), F.col("h").alias("up"))
    for phase in reversed(phases):
        whole = phase.drop("top").join(down, ["g", "block"]).withColumn("path", F.concat("path", "rest")).drop("block", "rest")
        down = whole.select("g", F.col("idx").alias("block"), F.col("path").alias("rest"), "up")
    return whole, roots


def manifest(rows: DataFrame, fields: list[str], group: str, key: str, also: dict[str, Column] | None = None,
             levels: int = LEVELS) -> DataFrame:
    """Per row: ``key``, ``leaf``, ``subroot``, ``root`` and ``path``, its siblings
    from the leaf upwards (``left``: the sibling stands before; ``sib`` null: there
    is none), and the columns ``also`` computed from the row."""
    extra = {f"x{i}": c for i, c in enumerate((also or {}).values())}
    g = F.when(rows[group].isNull(), "").otherwise(F.concat(F.lit("="), rows[group].cast("string")))
    leaves = rows.select(g.alias("g"), rows[key].alias("k"), leaf_of([rows[c] for c in fields]).alias("h"),
                         F.monotonically_increasing_id().alias("turn"), *[c.alias(x) for x, c in extra.items()])
    leaves = staged(leaves, "merkle-leaves")
    if leaves.isEmpty():
        names = ["k", *extra]
        return leaves.select(F.col("k").alias(key), F.col("h").alias("leaf"), F.col("h").alias("subroot"), F.col("h").alias("root"),
                             F.array().cast(_PATH).alias("path"), *[F.col(x).alias(a) for x, a in zip(names[1:], also or {})])
    inner, subroots = _trees(_numbered(leaves, ["k", "h", "turn"]).drop("turn"), levels)
    tops = _numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("k"), "h"), ["k"])
    outer, _ = _trees(tops, levels)
    outer = staged(outer.select(F.col("k").alias("g"), F.col("path").alias("over"), F.col("up").alias("root")), "merkle-roots")
    found = inner.join(outer, "g")
    return found.select(F.col("k").alias(key), F.col("h").alias("leaf"), F.col("up").alias("subroot"), "root",
                        F.concat("path", "over").alias("path"), *[F.col(x).alias(a) for x, a in zip(extra, also or {})])


def proof_digest(path: Column) -> Column:
    """Digest of a path's siblings, from the leaf upwards."""
    return digest(F.array_join(F.transform(path, lambda p: F.lower(F.hex(p["sib"]))), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to by ``path``."""
    def step(now: Column, p: Column) -> Column:
        sib = F.coalesce(F.lower(F.hex(p["sib"])), F.lit(""))
        return F.when(p["left"], digest(sib, now)).otherwise(digest(now, sib))

    return F.aggregate(path, leaf, step)
