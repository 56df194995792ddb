"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers, ``floor(scale * c) + shift``; the fit list holds each
distinct one once. Its covariance V is never formed: a pass over the fit list
gives ``V Q`` for a thin block Q, each task summing ``Xcᵀ(Xc Q)`` of its centred
rows (``n x - S`` in integers, then divided by ``n``, so centring loses nothing).
A round applies a Chebyshev polynomial of V to the block by its three-term
recurrence, one pass a term: the polynomial stays within 1 on the unwanted
spectrum, from 0 to the block's least Ritz value, and grows fast above it. QR and
Rayleigh-Ritz then give the round's eigenvalues and vectors.

Rounds go on until certified: the residuals ``|V q - e q|`` of all wanted
components are below ``TOLERANCE`` of the largest eigenvalue (or no longer fall,
at rounding error), and a fresh random block, kept orthogonal to the wanted
ones and filtered alike, finds no eigenvalue above the least of them. The block
is wider than wanted by ``GUARD`` columns, up to the dimension; a dimension so
small is solved by the first round.

Driver and tasks hold blocks of dimension x width numbers; sums are kept per
task and added by ``groupBy``, a row per matrix row.

Edge cases: vectors that are null, empty, or hold a null or non-finite entry
take no part; rows without an id take part; repeated vectors count once in the
fit and each row gets its result; vectors of other dimensions are fitted on
their own; components of zero variance (below ``RANK`` of the largest) are left
out, so one distinct vector alone gives no rows; equal eigenvalues may give any
basis of their space; ``deviation`` is null where it doesn't fit in 63 bits; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthvale.llm.common import ship, staged

DEGREE = 10           # most terms of a round's polynomial, one pass each
SPREAD = 1e12         # most by which it may raise the first wanted value over the last
GUARD = 16            # columns beyond the wanted ones
TOLERANCE = 1e-13     # residual, as a share of the largest eigenvalue
RANK = 1e-12
MAX_ROUNDS = 200
_BATCH = 4096


def integers(vectors: DataFrame, vec: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    def bad(x: Column) -> Column:
        y = x.cast("double")
        return y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))

    whole = F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")) + shift)
    return F.when(vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, bad), whole)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


class FitList:
    """The distinct integer vectors of one dimension, with passes over them."""

    def __init__(self, rows: DataFrame, dim: int):
        self.rows, self.dim = rows, dim
        self.n, self.sums = 0, np.zeros(dim, np.int64)
        whole = self._summed(lambda x: np.column_stack([np.full(dim, len(x)), x.sum(0)]), 2, exact=True)
        self.n, self.sums = int(whole[0, 0]), whole[:, 1].copy()

    def _summed(self, of, width: int, exact: bool = False) -> np.ndarray:
        """The sum over the fit list of ``of(block of rows)``, dim x width."""
        dim, kind = self.dim, np.int64 if exact else np.float64
        name = "long" if exact else "double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, some = np.zeros((dim, width), kind), False
            for b in batches:
                x = _matrix(b.column(0), dim)
                for at in range(0, len(x), _BATCH):
                    total, some = total + of(x[at:at + _BATCH]), True
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)),
                                                  *(pa.array(np.ascontiguousarray(total[:, j])) for j in range(width))],
                                                 names=["i", *(f"c{j}" for j in range(width))])

        sums = (self.rows.mapInArrow(run, "i int, " + ", ".join(f"c{j} {name}" for j in range(width)))
                .groupBy("i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(width)]).collect())    # dim rows
        out = np.zeros((dim, width), kind)
        for r in sums:
            out[r[0]] = r[1:]
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q."""
        n, sums = self.n, self.sums

        def of(x: np.ndarray) -> np.ndarray:
            c = (n * x - sums) / n
            return c.T @ (c @ q)

        return self._summed(of, q.shape[1]) / n

    def variances(self) -> np.ndarray:
        n, sums = self.n, self.sums
        return self._summed(lambda x: (((n * x - sums) / n) ** 2).sum(0)[:, None], 1)[:, 0] / n

    def gram(self, into: np.ndarray) -> np.ndarray:
        """Covariance of the centred rows times ``into``, dim x at most dim."""
        n, sums, dim = self.n, self.sums, self.dim

        def of(x: np.ndarray) -> np.ndarray:
            z = (n * x - sums) / n @ into
            out = np.zeros((dim, into.shape[1]))
            out[:into.shape[1]] = z.T @ z
            return out

        return self._summed(of, into.shape[1])[:into.shape[1]] / n


@dataclass(frozen=True)
class Whitening:
    dim: int
    n: int
    sums: np.ndarray
    values: np.ndarray       # eigenvalues, falling
    basis: np.ndarray        # unit eigenvectors, a column each
    trace: float
    identity_error: float
    passes: int


def _degree(least: float, last: float, most: float) -> int:
    """The polynomial's degree: a fast falling spectrum takes fewer terms, so
    that the last wanted value isn't lost in rounding beside the first."""
    grown = [np.arccosh(max(1.0, 2 * v / least - 1)) for v in (most, last)]
    return int(np.clip(np.log(SPREAD) / max(grown[0] - grown[1], 1e-9), 1, DEGREE))


def _filtered(times, q: np.ndarray, vq: np.ndarray, least: float, last: float, most: float) -> np.ndarray:
    """The block under the Chebyshev polynomial that damps 0..least and raises
    ``last`` and above; scaled so that ``most`` keeps its size. ``vq`` is V q."""
    half = least / 2
    sigma = first = half / (most - half)
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(2, _degree(least, last, most) + 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - half * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now / np.maximum(np.linalg.norm(now, axis=0), 1e-300)


def _rayleigh_ritz(times, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), their vectors and V times them."""
    q = np.linalg.qr(block)[0]
    vq = times(q)
    small = q.T @ vq
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def leading(times, dim: int, k: int, guard: int = GUARD, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their vectors of the positive
    semidefinite operator ``times``."""
    rng = np.random.default_rng(seed)
    k, width = min(k, dim), min(dim, k + guard)
    values, q, vq = _rayleigh_ritz(times, rng.standard_normal((dim, width)))
    last = np.inf
    for _ in range(MAX_ROUNDS):
        top = values[0]
        if top <= 0:                                                                    # no variance at all
            break
        off = np.linalg.norm(vq - q * values, axis=0)[:k].max()
        done = off <= TOLERANCE * top or (off <= 1e-10 * top and off > last / 2)       # as small, or no longer falling
        if width == dim and (done or off <= 1e-10 * top):
            break                                                                       # the block is the whole space
        if done:
            fresh = _unseen(times, q[:, :k], values, rng.standard_normal((dim, width - k)))
            if fresh is None:
                break
            q, last = np.column_stack([q[:, :k], fresh]), np.inf
            values, q, vq = _rayleigh_ritz(times, q)
            continue
        last = off
        least = max(values[-1], RANK * top)
        values, q, vq = _rayleigh_ritz(times, _filtered(times, q, vq, least, values[k - 1], top))
    else:
        raise RuntimeError(f"no certified eigenvectors after {MAX_ROUNDS} rounds")
    return values[:k], q[:, :k]


def _unseen(times, found: np.ndarray, values: np.ndarray, block: np.ndarray) -> np.ndarray | None:
    """A filtered random block orthogonal to ``found`` if it holds an eigenvalue
    above the least one found, else None."""
    def apart(x: np.ndarray) -> np.ndarray:
        return x - found @ (found.T @ x)

    def deflated(x: np.ndarray) -> np.ndarray:
        return apart(times(apart(x)))

    worst = max(values[found.shape[1] - 1], RANK * values[0])
    least = min(max(values[-1], RANK * values[0]), worst)
    block = np.linalg.qr(apart(block))[0]
    seen, fresh, _ = _rayleigh_ritz(deflated, _filtered(deflated, block, deflated(block), least, worst, worst))
    return apart(fresh) if seen[0] > worst + 1e-10 * values[0] else None


def fit(rows: DataFrame, dim: int, components: int = 16) -> Whitening:
    """``rows``: a column ``x`` of integer vectors of ``dim`` entries, distinct."""
    data, passes = FitList(rows, dim), [0]

    def times(q: np.ndarray) -> np.ndarray:
        passes[0] += 1
        return data.times(q)

    values, basis = leading(times, dim, components)
    real = values > RANK * max(values[0], 0.0) if values[0] > 0 else np.zeros(len(values), bool)
    values, basis = values[real], basis[:, real]
    error = float(np.abs(data.gram(basis / np.sqrt(values)) - np.eye(len(values))).max(initial=0.0)) if len(values) else 0.0
    return Whitening(dim, data.n, data.sums, values, basis, float(data.variances().sum()), error, passes[0])


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sums of ``(n x - S) ** 2``; null beyond 63 bits."""
    c = n * x - sums
    if float(np.abs(c).max(initial=0)) ** 2 * x.shape[1] < 2 ** 62:
        return pa.array((c * c).sum(1))
    whole = [sum(int(v) ** 2 for v in r) for r in c]
    return pa.array([v if v < 2 ** 63 else None for v in whole], pa.int64())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16,
           scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """One row per vector and component: the id, ``component, n, deviation,
    whitened, explained, identity_error``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(vectors[id_col].alias("id"), integers(vectors, vectors[vec_col], scale, shift).alias("x"))
    rows = staged(rows.filter("x IS NOT NULL").withColumn("dim", F.size("x")), "whitening-rows")
    fit_list = staged(rows.select("dim", "x").distinct(), "whitening-fit")
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, kind)] + [T.StructField(c, t) for c, t in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
        ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))])
    out = spark.createDataFrame([], schema)
    for dim in sorted(r[0] for r in fit_list.select("dim").distinct().collect()):     # usually one
        model = fit(fit_list.filter(F.col("dim") == dim).select("x"), dim, components)
        if len(model.values):
            mine = rows.filter(F.col("dim") == dim).select("id", "x")
            out = out.unionByName(mine.mapInArrow(_projected(model, schema), schema))
    return out


def _projected(model: Whitening, schema: T.StructType):
    k, into = len(model.values), model.basis / np.sqrt(model.values)
    explained = model.values / model.trace
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), model.dim)
            for at in range(0, len(x), _BATCH):
                part = x[at:at + _BATCH]
                m = len(part)
                each = np.repeat(np.arange(m), k)
                z = (model.n * part - model.sums) / model.n @ into
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, m).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)), _deviation(part, model.n, model.sums).take(pa.array(each)),
                    pa.array(z.reshape(-1)), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, model.identity_error))], names=names)

    return run
