"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are range-partitioned by length (ties spread by id) and every task
cuts its share into buckets of descending length. A query with k-th best score
t so far needs, in a bucket of largest length m, a cosine of at least
t / (|q| m). Above 1 the bucket is skipped; from ``COORD_FROM`` on candidates
must lie within the bounds which that cosine sets on the query's strongest
coordinates; below it only the vectors long enough are taken. Survivors are
verified by exact integer products. The first thresholds come from the
products with the longest vectors of all.

Queries are taken in blocks of at most ``QUERY_BLOCK``, one broadcast each, so
neither side is ever whole in one place.

Edge cases: vectors that are null, empty, or hold a null or non-finite
component take no part, nor do rows without an id; rows with the query's id
are its own row; of several query rows with one id the smallest vector counts;
a query meets vectors of its own dimension only; equal scores go to the
smaller id; fewer candidates than k give fewer rows; an empty table gives
none. Products must fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthvale.llm.common import ship, staged

QUERY_BLOCK = 16384
BUCKET_ROWS = 4096
SEED_ROWS = 4096
FOCUS = 4            # coordinates bounded per query
COORD_FROM = 0.35    # local cosine from which the bounds select enough
SLACK = 1e-9         # for the float bounds; products are exact


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """``id, v`` (array of long) of the vectors that take part."""
    def bad(x: Column) -> Column:
        y = x.cast("double")
        return y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))

    v = vectors[vec_col]
    rows = vectors.filter(vectors[id_col].isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad))
    return rows.select(F.col(id_col).cast("long").alias("id"),
                       F.transform(vec_col, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


class Queries:
    """A block of queries of one dimension, with their running thresholds."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int):
        self.ids, self.vecs, self.k = ids, vecs, k
        self.real = vecs.astype(np.float64)
        self.norm = np.sqrt((self.real ** 2).sum(1))
        self.unit = self.real / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1)[:, :FOCUS]
        self.top = np.abs(vecs).max(initial=0)
        self.floor = np.full(len(ids), -np.inf)                       # a score below it is not among the best k
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))   # query, score, id

    def products(self, q: np.ndarray, vecs: np.ndarray) -> np.ndarray:
        bound = float(self.top) * float(np.abs(vecs).max(initial=0)) * vecs.shape[1]
        if bound < 2 ** 53:                                            # exact in floating point
            return (self.real[q] @ vecs.T.astype(np.float64)).astype(np.int64)
        return self.vecs[q] @ vecs.T

    def take(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge candidates into the running best k."""
        other = self.ids[q] != ids
        q, score, ids = (np.concatenate(x) for x in zip(self.best, (q[other], score[other], ids[other])))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.searchsorted(q, q)                                  # where each query's run begins
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        self.best = q[keep], score[keep], ids[keep]
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])

    def visit(self, ids: np.ndarray, vecs: np.ndarray, norm: np.ndarray) -> None:
        """One bucket, in order of descending ``norm``."""
        with np.errstate(divide="ignore", invalid="ignore"):
            need = self.floor / self.norm                              # length needed at cosine 1
            cosine = np.where(self.floor > 0, need / norm[0] if norm[0] > 0 else np.inf, -1.0)
        cosine[(self.norm == 0) & (self.floor > 0)] = np.inf
        open_ = cosine <= 1 + SLACK
        by_length = np.flatnonzero(open_ & (cosine < COORD_FROM))
        got = []
        for i in range(0, len(by_length), 256):
            q = by_length[i:i + 256]
            least = need[q].min() if (self.floor[q] > 0).all() else -np.inf
            n = int(np.searchsorted(-norm, -(least - SLACK * abs(least)), side="right")) if np.isfinite(least) else len(norm)
            s = self.products(q, vecs[:n])
            a, b = np.nonzero(s >= self.floor[q][:, None])
            got.append((q[a], s[a, b], ids[:n][b]))
        by_coord = np.flatnonzero(open_ & (cosine >= COORD_FROM))
        if len(by_coord):
            unit = (vecs / np.where(norm > 0, norm, 1)[:, None]).T
            for q in by_coord:
                t = min(cosine[q], 1.0)
                rows = None
                for f in self.focus[q]:
                    x = self.unit[q, f]
                    spread = np.sqrt(max(0.0, (1 - x * x) * (1 - t * t)))
                    low = -1.0 if -x >= t else x * t - spread
                    high = 1.0 if x >= t else x * t + spread
                    u = unit[f] if rows is None else unit[f][rows]
                    ok = (u >= low - SLACK) & (u <= high + SLACK)
                    rows = np.flatnonzero(ok) if rows is None else rows[ok]
                    if not len(rows):
                        break
                if len(rows):
                    s = self.products(np.array([q]), vecs[rows])[0]
                    ok = s >= self.floor[q]
                    got.append((np.full(int(ok.sum()), q), s[ok], ids[rows[ok]]))
        if got:
            self.take(*(np.concatenate(x) for x in zip(*got)))


def _by_dimension(ids: np.ndarray, lists) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return {int(d): (ids[sizes == d], np.array([x for x, n in zip(lists, sizes) if n == d], np.int64))
            for d in np.unique(sizes)}


def top_products(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id",
                 vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query`` (an
    expression over ``id``) holds, against all rows."""
    spark = vectors.sparkSession
    ship(spark)
    rows = quantised(vectors, id_col, vec_col, scale)
    rows = staged(rows.withColumn("norm2", norm2(F.col("v"))), "vectors")
    asked = staged(rows.filter(is_query).groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    longest = rows.orderBy(F.desc("norm2"), "id").limit(SEED_ROWS).collect()       # bounded by SEED_ROWS
    seeds = _by_dimension(np.array([r["id"] for r in longest], np.int64), [r["v"] for r in longest])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.desc("norm2"), F.xxhash64("id")).sortWithinPartitions(F.desc("norm2"))

    def search(block: int) -> DataFrame:
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").collect()
        sides = {d: Queries(i, v, k) for d, (i, v) in
                 _by_dimension(np.array([r["id"] for r in mine], np.int64), [r["v"] for r in mine]).items()}
        for d, q in sides.items():
            if d in seeds:
                for at in range(0, len(q.ids), 1024):
                    part = np.arange(at, min(at + 1024, len(q.ids)))
                    s = q.products(part, seeds[d][1])
                    s[q.ids[part][:, None] == seeds[d][0][None, :]] = np.iinfo(np.int64).min
                    if s.shape[1] > k:
                        q.floor[part] = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
        start = spark.sparkContext.broadcast({d: (q.ids, q.vecs, q.floor) for d, q in sides.items()})

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {}
            for b in batches:
                ids, norm = b.column(0).to_numpy(), np.sqrt(b.column(2).to_numpy())
                lists = b.column(1)
                flat = lists.flatten().to_numpy()
                ends = np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))
                sizes = np.diff(ends, prepend=0)
                for d in np.unique(sizes):
                    if int(d) not in start.value:
                        continue
                    if int(d) not in found:
                        i, v, floor = start.value[int(d)]
                        found[int(d)] = Queries(i, v, k)
                        found[int(d)].floor = floor.copy()
                    here = np.flatnonzero(sizes == d)
                    vecs = flat[(ends[here] - d)[:, None] + np.arange(d)]
                    for at in range(0, len(here), BUCKET_ROWS):
                        part = slice(at, at + BUCKET_ROWS)
                        found[int(d)].visit(ids[here[part]], vecs[part], norm[here[part]])
            for q in found.values():
                i, s, v = q.best
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[i]), pa.array(s), pa.array(v)],
                                                 names=["query_id", "score", "vec_id"])

        return dealt.select("id", "v", "norm2").mapInArrow(visit, "query_id long, score long, vec_id long")

    out = search(0)
    for block in range(1, blocks):
        out = out.union(search(block))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
