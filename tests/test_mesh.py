"""Meshes of implicit surfaces: closed, oriented, of the right size; cells grow with the surface."""

import numpy as np
import pytest

from sphaera.functions.basis import harmonic_terms, monomial_terms
from sphaera.operators import mesh, moments, ransac
from sphaera.sources import generators


def sphere(radius):
    terms = monomial_terms(2)
    return terms, np.array([radius**-2 if max(t.coefficients[0][0]) == 2 else 0.0 for t in terms])


@pytest.mark.parametrize("radius", [0.5, 0.83])
def test_sphere(spark, radius):
    row = mesh.report(mesh.triangles(spark, *sphere(radius), 1.0, 6)).first()
    assert row.euler == 2 and row.open_edges == 0
    assert abs(row.area / (4 * np.pi * radius**2) - 1) < 0.01 and abs(row.volume / (4 / 3 * np.pi * radius**3) - 1) < 0.01


def test_fitted_surface(spark):
    """A hexagonal prism's surface of order 4: closed, all vertices on it, area close to that of a finer mesh."""
    cloud = generators.jittered(generators.hexagon_prism(spark, 2000), 0.007, 31)
    terms = harmonic_terms(4)
    beta = moments.Moments.of_cloud(cloud, 8).fit(terms, 2e-3)
    found = mesh.triangles(spark, terms, beta, 2.0, 6)
    row, fine = mesh.report(found).first(), mesh.report(mesh.triangles(spark, terms, beta, 2.0, 7)).first()
    assert row.open_edges == 0 and row.euler == 2 and row.volume > 0
    assert abs(row.area / fine.area - 1) < 0.01 and abs(row.volume / fine.volume - 1) < 0.01
    p = mesh.vertices(found).toPandas()
    r = ransac.residuals(ransac.Config(order=4), p[["x", "y", "z"]].to_numpy(), beta)
    assert p.vertex_id.is_unique and r.max() < 0.05


def test_torus_and_two_parts(spark):
    """Euler numbers tell a torus (0) from two spheres (4)."""
    from sphaera.functions.basis import Term

    def term(poly):
        return (Term(4, 0, "own", tuple(sorted(poly.items()))),)

    def product(p, q):
        out = {}
        for a, v in p.items():
            for b, w in q.items():
                e = tuple(x + y for x, y in zip(a, b, strict=True))
                out[e] = out.get(e, 0.0) + v * w
        return out

    square = {(2, 0, 0): 1.0, (0, 2, 0): 1.0, (0, 0, 2): 1.0}
    big, small = 0.6, 0.25
    ring = product({**square, (0, 0, 0): big**2 - small**2}, {**square, (0, 0, 0): big**2 - small**2})
    for e, v in (((2, 0, 0), -4 * big**2), ((0, 2, 0), -4 * big**2), ((0, 0, 0), 1.0)):
        ring[e] = ring.get(e, 0.0) + v
    row = mesh.report(mesh.triangles(spark, term(ring), np.ones(1), 1.0, 6)).first()
    assert row.euler == 0 and row.open_edges == 0 and abs(row.area / (4 * np.pi**2 * big * small) - 1) < 0.01
    ball = lambda x: {**square, (1, 0, 0): -2 * x, (0, 0, 0): x * x - 0.09}
    two = product(ball(0.5), ball(-0.5))
    two[0, 0, 0] += 1.0
    assert mesh.report(mesh.triangles(spark, term(two), np.ones(1), 1.0, 6)).first().euler == 4


def test_cells_grow_with_the_surface(spark):
    terms, beta = sphere(0.7)
    sizes = [mesh.cells(spark, terms, beta, 1.0, n).count() for n in (4, 5, 6, 7)]
    assert all(3 < b / a < 5 for a, b in zip(sizes, sizes[1:])) and sizes[-1] < 0.06 * 8**7


def test_bounds_hold():
    """No value in a cell leaves the bound, and bounds get tight."""
    r = np.random.default_rng(8)
    terms, centres = harmonic_terms(4), r.uniform(-1, 1, (50, 3))
    beta = r.normal(size=len(terms))
    for half in (0.3, 0.01):
        value, spread = mesh.taylor_bound(terms, beta, centres, half)
        inside = centres[:, None, :] + r.uniform(-half, half, (50, 200, 3))
        f = ransac.compiled(terms).value(inside.reshape(-1, 3), beta).reshape(50, 200) - 1
        assert (np.abs(f - value[:, None]) <= spread[:, None] + 1e-9).all()
    assert (spread < 1).all()


def test_no_surface_and_open_ones(spark):
    terms, beta = sphere(5.0)
    row = mesh.report(mesh.triangles(spark, terms, beta, 1.0, 4)).first()
    assert (row.n_vertices, row.n_triangles, row.area) == (0, 0, 0.0)
    row = mesh.report(mesh.triangles(spark, *sphere(1.2), 1.0, 4)).first()
    assert row.n_triangles > 0 and row.open_edges > 0
    with pytest.raises(ValueError):
        mesh.cells(spark, terms, beta, 1.0, 0)
