"""Embedding whitening against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthvale.llm import queries, whitening

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, x string, dim string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "d", "i") for i, v in rows], SCHEMA)


def brute(vectors, components=16):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    c = (n * fit - total) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    z = (n * x - total) / n @ u / np.sqrt(e)
    return n, ((n * x.astype(object) - total) ** 2).sum(1), z, e / (c ** 2).sum() * n


def test_query_equals_numpy(spark):
    src = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, z, explained = brute([r.embedding for r in src])
    got = queries.op13_whitening(spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    assert got.vec_id.tolist() == [r.vec_id for r in src for _ in range(16)]
    assert (got.n == n).all() and got.component.tolist() == list(range(1, 17)) * len(src)
    assert got.deviation.tolist() == [d for d in deviation for _ in range(16)]
    w = got.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(w - z * np.sign((w * z).sum(0))).max() < 1e-9
    assert np.allclose(got.explained.to_numpy().reshape(-1, 16), explained, rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


def test_copies_count_once_and_odd_rows_take_no_part(spark):
    rng = np.random.default_rng(1)
    good = [[float(v) for v in r] for r in rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.2]]
    rows = [*enumerate(good), (None, good[0]), (0, good[0]), *[(100 + i, good[7]) for i in range(40)],
            (200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5)]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    n, _, z, _ = brute(good)
    assert (got.n == n).all() and len(got) == 5 * 102 and got.vec_id.isna().sum() == 5
    of7 = got[got.vec_id.isin([7, *range(100, 140)])].groupby("component").whitened.nunique()
    assert (of7 == 1).all()
    assert not set(got.vec_id.dropna()) & set(range(200, 205))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_variance_gives_no_rows(spark, rows):
    out = whitening.whiten(frame(spark, rows))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.collect() == []


def test_components_stop_at_the_rank_and_dimensions_stay_apart(spark):
    rows = [(i, [float(i), float(2 * i), 0.0]) for i in range(20)] + [(100 + i, [float(i), float(i * i % 7)]) for i in range(20)]
    got = whitening.whiten(frame(spark, rows)).groupBy(F.col("vec_id") >= 100).agg(
        F.max("component").alias("c"), F.max("n").alias("n"), F.count("*").alias("rows")).collect()
    assert {tuple(r) for r in got} == {(False, 1, 20, 20), (True, 2, 20, 40)}


@pytest.mark.parametrize("spectrum", [np.linspace(2, 1, 80), np.r_[np.full(20, 3.0), np.ones(60)], 0.5 ** np.arange(80), np.r_[1e6, np.ones(79) + np.arange(79) * 1e-3]])
def test_leading_eigenvalues_of_hard_spectra(spectrum):
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((80, 80)))[0]
    v = (q * spectrum) @ q.T
    values, basis = whitening.leading(lambda x: v @ x, 80, 16)
    assert np.allclose(values, np.sort(spectrum)[::-1][:16], rtol=1e-10, atol=1e-10 * spectrum.max())
    assert np.abs(basis.T @ basis - np.eye(16)).max() < 1e-12
    assert np.abs(v @ basis - basis * values).max() < 1e-9 * spectrum.max()


def test_deviation_beyond_63_bits_is_null():
    x = np.array([[2_000_000, 0], [1, 1]])
    assert whitening._deviation(x, 10 ** 9, np.array([0, 0])).to_pylist() == [None, 2 * 10 ** 18]
