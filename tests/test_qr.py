"""Fits and spectra by QR against independent solutions with 60 digits."""

import decimal
from decimal import Decimal

import numpy as np
import pytest

from sphaera.functions.basis import harmonic_terms, monomial_terms, penalty
from sphaera.operators import linalg
from sphaera.plans import catalogue

DATA = "/root/testdata/sf0.001"


def products(terms, points):
    """Gram matrix and sums of the terms, from the doubles as they are, with 60 digits."""
    design = []
    for p in points:
        x = [Decimal(float(v)) for v in p]
        design.append([sum((Decimal(v) * x[0] ** a * x[1] ** b * x[2] ** c for (a, b, c), v in t.coefficients), Decimal(0)) for t in terms])
    n = len(terms)
    g = [[Decimal(0)] * n for _ in range(n)]
    for row in design:
        for i in range(n):
            for j in range(i, n):
                g[i][j] += row[i] * row[j]
    for i in range(n):
        for j in range(i):
            g[i][j] = g[j][i]
    return g, [sum(row[i] for row in design) for i in range(n)]


def eliminated(matrix, right):
    a = [[*row, b] for row, b in zip(matrix, right, strict=True)]
    n = len(a)
    for k in range(n):
        p = max(range(k, n), key=lambda i: abs(a[i][k]))
        a[k], a[p] = a[p], a[k]
        for i in range(k + 1, n):
            f = a[i][k] / a[k][k]
            for j in range(k, n + 1):
                a[i][j] -= f * a[k][j]
    out = [Decimal(0)] * n
    for k in reversed(range(n)):
        out[k] = (a[k][n] - sum(a[k][j] * out[j] for j in range(k + 1, n))) / a[k][k]
    return out


def least_eigenvalue(matrix):
    v = [Decimal(1 + i % 3) for i in range(len(matrix))]
    for _ in range(250):
        w = eliminated(matrix, v)
        size = max(map(abs, w))
        v = [x / size for x in w]
    product = [sum(a * b for a, b in zip(row, v, strict=True)) for row in matrix]
    return sum(a * b for a, b in zip(product, v, strict=True)) / sum(a * a for a in v)


@pytest.fixture(autouse=True)
def sixty_digits():
    with decimal.localcontext() as c:
        c.prec = 60
        yield


def cloud_of(spark, points):
    return spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double, z double").repartition(5)


def test_fit_o6_of_the_table(spark):
    terms = harmonic_terms(6)
    points = catalogue.cloud_of(spark, DATA).toPandas()[["x", "y", "z"]].to_numpy()
    g, m = products(terms, points)
    for i, w in enumerate(penalty(terms, 6)):
        g[i][i] += Decimal(catalogue.RIDGE) * len(points) * Decimal(float(w))
    want = [float(b) for b in eliminated(g, m)]
    got = linalg.fit_qr(catalogue.cloud_of(spark, DATA), terms, catalogue.RIDGE, 6)
    assert np.allclose(got, want, rtol=1e-8, atol=1e-9 * np.abs(want).max())
    rows = {r.term: r.beta for r in catalogue.queries()["fit_o6"](spark, DATA).collect()}
    assert all(abs(rows[k] - b) <= 0.51e-5 + 1e-9 * abs(b) for k, b in enumerate(want))


def test_spectrum_of_the_table(spark):
    points = catalogue.cloud_of(spark, DATA).toPandas()[["x", "y", "z"]].to_numpy()
    terms = harmonic_terms(4)
    g, _ = products(terms, points)
    ev = linalg.spectrum_qr(catalogue.cloud_of(spark, DATA), terms)
    n = len(points)
    assert np.allclose(ev, np.linalg.eigvalsh(np.array(g, float) / n)[::-1], rtol=1e-8)
    assert np.isclose(ev.sum(), float(sum(g[i][i] for i in range(15)) / n)) and np.isclose(ev[-1], float(least_eigenvalue(g) / n), rtol=1e-9)
    shrunk = {r.strength: (r.least, r["median"], r.largest) for r in catalogue.queries()["shrinkage"](spark, DATA).collect()}
    assert all(np.allclose(v, [e / (e + s) for e in (ev[-1], np.median(ev), ev[0])], rtol=1e-9) for s, v in shrunk.items())


def test_near_singular_cloud(spark):
    """Points that all but lie in a plane: the design's condition number is over 1e9, its square beyond doubles."""
    r = np.random.default_rng(2)
    points = r.normal(size=(60, 3))
    points[:, 2] = points[:, 0] + points[:, 1] + 1e-9 * points[:, 2]
    terms = monomial_terms(1)
    g, m = products(terms, points)
    want = [float(b) for b in eliminated(g, m)]
    got = linalg.fit_qr(cloud_of(spark, points), terms)
    design = np.stack([t.values(points) for t in terms], 1)
    assert np.linalg.cond(design) > 1e9
    assert np.allclose(got, want, rtol=1e-4) and linalg.fit(cloud_of(spark, points), terms) is None
    assert np.isclose(linalg.spectrum_qr(cloud_of(spark, points), terms)[-1], float(least_eigenvalue(g)) / 60, rtol=1e-5)


def test_dependent_and_few_points(spark):
    terms = harmonic_terms(2)
    flat = np.zeros((40, 3))
    flat[:, :2] = np.random.default_rng(3).normal(size=(40, 2))
    assert linalg.fit_qr(cloud_of(spark, flat), terms) is None
    assert linalg.fit_qr(cloud_of(spark, flat), terms, 1e-3) is not None
    assert linalg.fit_qr(cloud_of(spark, flat[:3]), terms) is None
    assert linalg.fit_qr(cloud_of(spark, flat).limit(0), terms) is None


def test_triangles_merge_in_a_tree(spark, monkeypatch):
    points = np.random.default_rng(4).normal(size=(300, 3))
    terms = harmonic_terms(4)
    whole = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double, z double")
    monkeypatch.setattr(linalg, "MERGED", 2)
    one, rows = linalg.triangle(whole.repartition(1), terms)
    many, n = linalg.triangle(whole.repartition(7), terms)
    assert rows == n == 300 and np.allclose(one.T @ one, many.T @ many, rtol=1e-11, atol=1e-9)


@pytest.mark.parametrize("name", ["lambda_sweep"])
def test_sweep_of_the_table(spark, name):
    """Twelve strengths at order 6: norms and mean squares of the solutions with 60 digits."""
    terms = harmonic_terms(6)
    points = catalogue.cloud_of(spark, DATA).toPandas()[["x", "y", "z"]].to_numpy()
    g, m = products(terms, points)
    rows = {r.strength: r for r in catalogue.queries()[name](spark, DATA).collect()}
    assert len(rows) == 12
    for strength in (1e-3, 0.5, 1000.0):
        own = [list(row) for row in g]
        for i, w in enumerate(penalty(terms, 6)):
            own[i][i] += Decimal(strength) * len(points) * Decimal(float(w))
        b = eliminated(own, m)
        square = sum(b[i] * b[j] * g[i][j] for i in range(28) for j in range(28)) - 2 * sum(x * y for x, y in zip(b, m, strict=True)) + len(points)
        assert abs(rows[strength].beta_norm - float(sum(x * x for x in b))) < 1e-4 * max(1, rows[strength].beta_norm)
        assert abs(rows[strength].mse - float(square) / len(points)) < 1e-4
