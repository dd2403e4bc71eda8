"""Whitening against exact sums and a library's eigenvectors."""

import random
from fractions import Fraction

import numpy as np
import pytest

from chatlake.llm import queries, whitening


def brute(vectors, scale=64, shift=1_000_000):
    """Rows, n, sums, covariance and deviations of the vectors that take part (of one length), exactly."""
    import math

    rows = [(i, [math.floor(scale * c) + shift for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    listed = sorted({tuple(x) for _, x in rows})
    n, d = len(listed), len(listed[0])
    sums = [sum(x[k] for x in listed) for k in range(d)]
    cov = np.array([[float(Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in listed), n**3)) for b in range(d)] for a in range(d)])
    return rows, n, sums, cov, {tuple(x): sum((n * x[k] - sums[k]) ** 2 for k in range(d)) for _, x in rows}


def hold(spark, vectors, most=16):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS id", "'x' AS dim", "'x' AS n")
    got = whitening.whitened(df.repartition(3), most).collect()
    rows, n, sums, cov, deviation = brute(vectors)
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    k = min(most, int((values > values[0] * 1e-12).sum()))
    assert len(got) == k * len(rows) and all(r.n == n for r in got)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    # equal ids may stand for several vectors; here every id has one
    for i, x in rows:
        mine = sorted((r for r in by[(i, deviation[tuple(x)])]), key=lambda r: r.component)
        want = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ vecs[:, :k] / np.sqrt(values[:k])
        have = np.array([r.whitened for r in mine]).reshape(-1, k) if mine else None
        np.testing.assert_allclose(np.abs(have), np.abs(np.tile(want, (len(have), 1))), rtol=1e-6, atol=1e-7)
        np.testing.assert_allclose([r.explained for r in mine[:: max(1, len(mine) // k)]], values[:k] / np.trace(cov), rtol=1e-8)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_against_exact(spark):
    rng = random.Random(1)
    base = [(i, [rng.gauss(0, 1 + k) + (rng.random() if k % 3 else 0) * i / 50 for k in range(20)]) for i in range(150)]
    odd = [(500, None), (501, [None] + [0.0] * 19), (502, [float("nan")] * 20), (503, [float("inf")] * 20)]
    hold(spark, base + odd + [(1000 + i, base[0][1]) for i in range(200)])


def test_far_from_zero(spark):
    """A mean a million times the spread costs no digits."""
    rng = random.Random(2)
    hold(spark, [(i, [30000.0 + rng.choice([0, 1 / 64]) for _ in range(6)]) for i in range(60)])


def test_large_entries(spark):
    rows = [(i, [2.0**50 * (i - 5), 2.0**49 * (i % 3), 1.0 * i]) for i in range(11)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 22 and {r.deviation for r in got if r.vec_id == 0} == {None}  # the third is below double precision
    assert all(r.identity_error < 1e-9 for r in got)


def test_without_variance(spark):
    kind = "vec_id long, embedding array<double>"
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, []), (2, [])]):
        assert whitening.whitened(spark.createDataFrame(rows, kind)).count() == 0
    got = whitening.whitened(spark.createDataFrame([(None, [1.0, 2.0]), (2, [3.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0, 1.0, 1.0])], kind)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, round(abs(r.whitened), 9), r.explained) for r in got) == [(0, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0)]


@pytest.mark.parametrize("d", [1, 2, 7, 33])
def test_factor(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, max(1, d - 2))) * 10.0 ** rng.uniform(-4, 4, max(1, d - 2))
    a = a @ a.T
    f = whitening.pivoted_cholesky(a)
    np.testing.assert_allclose(f @ f.T, a, atol=1e-12 * np.abs(a).max())
    values, vectors = whitening.one_sided_jacobi(f)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    np.testing.assert_allclose(values, np.linalg.eigvalsh(a)[::-1][: len(values)], atol=1e-12 * values[0])
    assert whitening.one_sided_jacobi(whitening.pivoted_cholesky(np.zeros((d, d))))[0].size == 0


def test_query(spark, sf):
    out = queries.QUERIES["op12_whitening"](spark, sf)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert out.count() == 16 * rows and out.agg({"identity_error": "max"}).first()[0] < 1e-9
