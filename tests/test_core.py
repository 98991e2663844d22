"""Bases, solves, local refinement, consensus, portable functions."""

import itertools
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
import solver_by_hand as by_hand
from pyspark.sql import functions as F

from sphaera.functions import basis
from sphaera.functions.portable import hazen, uniform
from sphaera.operators import analysis, linalg, moments, ransac, score, tables
from sphaera.sources import clouds, generators, ply
from sphaera.streaming import log_stream

R = np.random.default_rng(1)


@pytest.mark.parametrize(("order", "n"), [(2, 6), (3, 10), (4, 15), (6, 28)])
def test_harmonic_basis(order, n):
    terms = basis.harmonic_terms(order)
    assert len(terms) == n
    p = R.normal(size=(50, 3))
    phi, r2 = basis.design(terms, p), (p**2).sum(1)
    for level in range(order, -1, -2):  # addition theorem
        own = [k for k, t in enumerate(terms) if t.level == level]
        assert len(own) == 2 * level + 1
        assert np.allclose((phi[:, own] ** 2).sum(1), r2**order)
    grads = [np.stack([t.derivative(a).values(p) for t in terms], 1) for a in range(3)]
    assert np.allclose(sum(p[:, [a]] * grads[a] for a in range(3)), order * phi)  # Euler's identity
    for a in range(3):
        step = np.zeros(3)
        step[a] = 1e-6
        assert np.allclose((basis.design(terms, p + step) - basis.design(terms, p - step)) / 2e-6, grads[a], rtol=1e-4, atol=1e-4)


def test_order_two_is_the_known_one():
    p = R.normal(size=(20, 3))
    x, y, z = p.T
    s = np.sqrt(3)
    want = np.stack([z * z - (x * x + y * y) / 2, s * x * z, s * y * z, s / 2 * (x * x - y * y), s * x * y, x * x + y * y + z * z], 1)
    assert np.allclose(basis.design(basis.harmonic_terms(2), p), want)


def test_monomials_and_penalties():
    terms = basis.monomial_terms(3)
    assert len(terms) == 10 and len({t.coefficients for t in terms}) == 10
    assert np.allclose(basis.ridge_diagonal(6, 1.0), basis.penalty(basis.harmonic_terms(6), 6))
    assert basis.ridge_diagonal(2, [3.0, 1.0]).tolist() == [3.0] * 5 + [1.0]
    with pytest.raises(ValueError):
        basis.ridge_diagonal(4, [1.0])


@pytest.mark.parametrize("order", [2, 6])
def test_gram_and_solve(spark, order):
    p = R.normal(size=(300, 3))
    c = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "point_id bigint, x double, y double, z double").repartition(5)
    terms = basis.harmonic_terms(order)
    g = linalg.Gram.collect(linalg.gram(c, terms), len(terms))
    phi = basis.design(terms, p)
    assert np.allclose(g.matrix, phi.T @ phi) and np.allclose(g.moment, phi.sum(0)) and g.rows == 300
    assert np.allclose(linalg.fit(c, terms), np.linalg.lstsq(phi, np.ones(300), rcond=None)[0], atol=1e-6)
    beta = linalg.fit(c, terms, 0.01, order)
    assert np.allclose((phi.T @ phi + 3.0 * np.diag(basis.penalty(terms, order))) @ beta, phi.sum(0))
    assert np.allclose(linalg.fit(c.union(c), terms, 0.01, order), beta)  # the strength does not depend on the rows
    assert linalg.fit(c.limit(3), terms) is None
    sdf = score.with_distance(c, terms, beta).select("sdf").first()[0]
    assert np.isfinite(sdf)


def test_shift_step_matches_numpy(spark):
    p = R.normal(size=(200, 3)) + 0.1
    c = spark.createDataFrame([tuple(map(float, v)) for v in p], "x double, y double, z double")
    terms = basis.harmonic_terms(2)
    beta = linalg.fit(c, terms, 1e-3, 2)
    g = np.stack([np.stack([t.derivative(a).values(p) for t in terms], 1) @ beta for a in range(3)], 1)
    want = np.linalg.solve(g.T @ g, g.T @ (1 - basis.design(terms, p) @ beta))
    assert np.allclose(list(linalg.shift_step(c, terms, beta).first()), want)


def test_refinement_has_finite_steps():
    p = R.normal(size=(400, 3))
    p /= np.linalg.norm(p, axis=1)[:, None]
    p = p[p[:, 2] > -0.3] + [0.12, -0.07, 0.20]
    errors = []
    for n in (4, 20, 60):
        disp, _ = by_hand.Solver(ransac.Config(order=2, loc_iters=n)).refine(p)
        errors.append(np.abs(disp - [0.12, -0.07, 0.20]).max())
    assert errors[2] < 1e-3 < errors[0] and errors[1] < errors[0]


def test_consensus(spark):
    cloud = clouds.concatenated(generators.jittered(generators.sphere(spark, 400, 3), 0.005, 9), generators.outliers(spark, 80, 2.0, 4), 400, 80)
    frozen = ransac.Config(config_id=1, order=2, k_mult=1.5, strength=1e-3, max_iter=30, thresh=0.3, freeze_w=True, freeze_omega=True)
    adaptive = ransac.Config(config_id=2, order=2, k_mult=1.5, strength=1e-3, max_iter=30, thresh=0.3, update_thresh=0.6)
    log = ransac.run(cloud, [frozen, adaptive]).toPandas()
    assert sorted(log.groupby("config_id").size()) == [30, 30]
    seen = log[~np.isnan(log.post_score)]
    assert ((seen.tp + seen.fp + seen.fn + seen.tn) == 480).all() and seen.post_score.between(0, 1).all()
    best = ransac.best_models(spark.createDataFrame(log[log.config_id == 2], ransac.LOG_SCHEMA)).first()
    own = seen[seen.config_id == 2]
    assert best.post_score == own.post_score.max() and best.iter_no == own[own.post_score == best.post_score].iter_no.max()
    assert best.recall > 0.9 and best.precision > 0.85
    assert np.abs(best.disp).max() < 0.2
    assert ransac.run(cloud.limit(0), [frozen]).count() == 0
    with pytest.raises(NotImplementedError):
        ransac.Config(is_global=True)


LOG_NAMES = "pre_score post_score inlier_ratio beta_norm mse_all mse_inlier w max_n max_iter tp fp fn tn precision recall f1".split()


def assert_like_by_hand(rows, config, points, truth, centre):
    want = list(by_hand.iterate(config, points - centre, truth))
    assert len(rows) == len(want)
    for got, row in zip(rows, want, strict=True):
        assert got.iter_no == row["iter_no"] and got.singular == row["singular"]
        for name in LOG_NAMES:
            assert np.isclose(got[name], row[name], rtol=1e-7, equal_nan=True), (got.iter_no, name, got[name], row[name])
        assert (got.disp is None) == (row["disp"] is None)
        if got.disp is not None:
            assert np.allclose(got.disp, np.array(row["disp"]) + centre, atol=1e-8) and np.allclose(got.beta, row["beta"], atol=1e-6)


@pytest.mark.parametrize(("with_truth", "few"), [(True, 4096), (False, 0)])
def test_solver_in_blocks_equals_the_loop(spark, monkeypatch, with_truth, few):
    """Blocks of 64 points in several parts, weights stored anew every third surface: the rows of the loop over one matrix, wherever the blocks' sums are kept."""
    monkeypatch.setattr(ransac, "FEW_BLOCKS", few)
    monkeypatch.setattr(ransac, "BLOCK", 64)
    monkeypatch.setattr(ransac, "KEEP", 3)
    monkeypatch.setattr(ransac, "AT_ONCE", 7)
    cloud = clouds.concatenated(generators.jittered(generators.sphere(spark, 500, 3), 0.01, 9), generators.outliers(spark, 120, 2.0, 4), 500, 120)
    cloud = clouds.shifted(cloud, (-0.4, 0.2, 0.1)).withColumn("point_id", (F.col("point_id") * 7919 % 10007) - 5000)
    p = cloud.toPandas().sort_values("point_id")
    points, truth = p[["x", "y", "z"]].to_numpy(), p["gt"].to_numpy(bool) if with_truth else None
    common = {"order": 2, "k_mult": 1.5, "strength": 1e-3, "thresh": 0.3}
    configs = [
        ransac.Config(config_id=1, max_iter=12, **common),
        ransac.Config(config_id=2, max_iter=20, freeze_omega=True, update_thresh=0.9, freeze_iter=False, **common),
        ransac.Config(config_id=3, max_iter=9, freeze_w=True, freeze_omega=True, seed=5, **common),
        ransac.Config(config_id=4, max_iter=8, freeze_iter=False, conf=0.5, seed=9, **common | {"order": 4, "k_mult": 0.8}),
    ]
    log = ransac.run(cloud if with_truth else cloud.drop("gt"), configs).orderBy("config_id", "iter_no").collect()
    for c in configs:
        assert_like_by_hand([r for r in log if r.config_id == c.config_id], c, points, truth, points.mean(0))
    assert sum(r.post_score == r.post_score for r in log if r.config_id == 1) > 6  # weights were stored anew


def test_solver_edges(spark, monkeypatch):
    """Few points, equal ids, samples without a unique surface, a threshold that nothing meets."""
    rows = [(i % 3, float(i % 2), 1.0, float(i)) for i in range(9)]
    cloud = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    log = ransac.run(cloud, [ransac.Config(order=2, max_iter=3), ransac.Config(config_id=2, order=2, max_iter=3, strength=0.1, thresh=1e-12)]).collect()
    assert all(r.singular and r.pre_score != r.pre_score for r in log if r.config_id == 1)
    assert all(not r.singular and r.pre_score > 0 and r.post_score != r.post_score for r in log if r.config_id == 2)
    assert ransac.solve_cloud(cloud, ransac.Config(order=2, max_iter=2)).count() == 0
    assert ransac.run(cloud, []).count() == 0


def test_moments_translate():
    p = R.normal(size=(300, 3))
    for degree in (2, 5, 8):
        m = moments.Moments.of_points(p, degree)
        moved = m.translated(np.array([0.3, -0.2, 0.1])).dense
        for a, b, c in moments.exponents(degree):
            q = p + [0.3, -0.2, 0.1]
            assert np.isclose(moved[a, b, c], (q[:, 0] ** a * q[:, 1] ** b * q[:, 2] ** c).sum(), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize(("order", "strength"), [(2, 0.0), (4, 0.0), (4, 2e-3), (6, 2e-3)])
def test_refinement_from_moments(spark, order, strength):
    """Displacement to 1e-10 and coefficients to 1e-8 of those that pass over the points for every step."""
    p = R.normal(size=(700, 3))
    p = p / np.linalg.norm(p, axis=1)[:, None] * [1, 0.9, 0.8] + R.normal(size=p.shape) * 0.02 + [0.12, -0.07, 0.2]
    cloud = spark.createDataFrame([tuple(map(float, v)) for v in p], "x double, y double, z double").repartition(3)
    s = by_hand.Solver(ransac.Config(order=order, strength=strength))
    disp, beta = s.refine(p)
    m = moments.Moments.of_cloud(cloud, 2 * order)
    got, own = moments.refine(m, s.terms, 4, 0.66, 0.85, strength, s.weights)
    assert np.allclose(got, disp, atol=1e-10) and np.allclose(own, beta, rtol=1e-8, atol=1e-8 * np.abs(beta).max())
    assert np.isclose(m.square_residuals(s.terms, beta), ((basis.design(s.terms, p) @ beta - 1) ** 2).sum(), rtol=1e-6)
    assert moments.Moments.of_cloud(cloud.limit(0), 2 * order).count == 0


def test_weights_follow_the_closed_form():
    pts = R.normal(size=(60, 3))
    c = ransac.Config(order=2, k_mult=2.0, max_iter=6, strength=1e-3)
    rows = list(by_hand.iterate(c, pts, None))
    mass = 4.6 + sum(r["post_score"] for r in rows if r["soft"] is not None)
    closed = (4.6 * 0.33 + sum(r["post_score"] * r["soft"] for r in rows if r["soft"] is not None)) / mass
    omega, m = np.full(60, 0.33), 4.6
    for r in rows:
        if r["soft"] is not None:
            omega = (m * omega + r["post_score"] * r["soft"]) / (m + r["post_score"])
            m += r["post_score"]
    assert np.allclose(omega, closed)


def test_first_bound_and_implied_one():
    """At w 0.65, six draws and confidence 0.96, theory asks for 42 iterations; a frozen bound keeps what it was given."""
    pts = R.normal(size=(60, 3))
    free = ransac.Config(order=2, k_mult=1.0, max_iter=100, conf=0.96, min_inlier_ratio=0.65, freeze_w=True, freeze_iter=False, thresh=1e-9, strength=1e-3)
    assert ransac.theoretical_n(0.65, 6, 0.96) == 42
    rows = list(by_hand.iterate(free, pts, None))
    assert len(rows) == 42 and {r["max_iter"] for r in rows} == {42.0} and {r["max_n"] for r in rows} == {84.0}
    kept = list(by_hand.iterate(ransac.replace(free, freeze_iter=True, max_iter=50), pts, None))
    assert len(kept) == 50 and {r["max_iter"] for r in kept} == {50.0} and kept[0]["max_n"] == 84.0


def test_solver_with_a_basis_of_ones_own(spark):
    terms = basis.monomial_terms(2)
    cloud = generators.jittered(generators.sphere(spark, 300, 3), 0.005, 9)
    config = ransac.Config(order=2, terms=terms, k_mult=2.0, strength=1e-4, max_iter=20, thresh=0.3)
    assert config.sample_size == 12
    row = ransac.solve_cloud(cloud, config).first()
    assert len(row.beta) == 6 and row.inlier_ratio > 0.99 and row.raw_ms > 0 and row.loc_ms > 0
    ball = [1.0 if max(t.coefficients[0][0]) == 2 else 0.0 for t in terms]  # x2 + y2 + z2
    assert np.allclose(row.beta, ball, atol=0.05)


def test_running_values_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(analysis, "BLOCK", 7)
    v = R.random(60)
    at = np.sort(R.choice(300, 60, replace=False))
    rows = spark.createDataFrame([(None if k < 30 else 1, int(i), float(x) if k % 9 else float("nan")) for k, (i, x) in enumerate(zip(at, v))], "k int, i int, v double")
    best = {(r.k, r.i): (r.best, r.gate) for r in analysis.running(rows, ["k"], "i", "v", 0.13).collect()}
    n = {(r.k, r.i): r.n for r in analysis.ranked(rows, ["k"], "i", "n").collect()}
    ema = {(r.k, r.i): r.w for r in analysis.moving_average(rows.fillna(0.0, ["v"]), ["k"], "i", "v", 0.65, 0.3).collect()}
    seen, w = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.i):
        own = seen.setdefault(r.k, [])
        good = [x for x in own if x == x]
        assert best[r.k, r.i][0] == max([0.13, *good]) and n[r.k, r.i] == len(own) + 1
        own.append(r.v)
        w[r.k] = 0.3 * w.get(r.k, 0.65) + 0.7 * (r.v if r.v == r.v else 0.0)
        assert np.isclose(ema[r.k, r.i], w[r.k], atol=1e-14)


def test_runs_may_be_repeated(spark, tmp_path):
    path, schema = str(tmp_path / "results"), "k int, name string"
    assert tables.read_results(spark, path, schema, ["k"]).collect() == []
    batch = lambda tag, n: spark.createDataFrame([(i % 10, f"{tag}{i:02d}") for i in range(n)], schema).repartition(7)
    tables.append_results(batch("x", 50), path, "run-01")
    first = {(r.run, r.k, r.name): r.row_id for r in tables.read_results(spark, path, schema, ["k", "name"]).collect()}
    fails = batch("y", 30).withColumn("name", F.when(F.col("k") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        tables.append_results(fails, path, "run-02")
    assert {(r.run, r.k, r.name): r.row_id for r in tables.read_results(spark, path, schema, ["k", "name"]).collect()} == first
    with ThreadPoolExecutor(2) as pool:  # two writers at once, one of them a repeat
        list(pool.map(lambda v: tables.append_results(batch(v[0], v[1]), path, v[2]), [("y", 30, "run-02"), ("x", 50, "run-01")]))
    tables.append_results(batch("y", 30), path, "run-02")
    found = tables.read_results(spark, path, schema, ["k", "name"]).orderBy("row_id").collect()
    assert [r.row_id for r in found] == list(range(1, 81))
    assert [(r.run, r.k, r.name) for r in found] == sorted((f"run-0{1 + (t == 'y')}", i % 10, f"{t}{i:02d}") for t, n in (("x", 50), ("y", 30)) for i in range(n))
    assert {k: v for k, v in ((tuple(r)[1:], r.row_id) for r in found) if k in first} == first
    with pytest.raises(ValueError):
        tables.append_results(batch("z", 1).withColumn("run", F.lit(1)), path, "run-03")


def test_ply_of_many_splits(spark, tmp_path):
    """Two files, cut into many tasks: other columns, faces behind the vertices, line ends of two bytes; one of them named twice."""
    r = np.random.default_rng(4)
    clouds_of = {}
    for name, n, end in (("a", 2000, "\n"), ("b", 1500, "\r\n")):
        p = r.normal(size=(n, 3))
        head = ["ply", "format ascii 1.0", "comment made by hand", f"element vertex {n}", *[f"property {t}" for t in ("double z", "uchar red", "double x", "double y")], "element face 3", "property list uchar int vertex_indices", "end_header"]
        rows = [f"{z!r} 7 {x!r} {y!r}" for x, y, z in p.tolist()] + ["3 0 1 2"] * 3
        (tmp_path / f"{name}.ply").write_bytes(end.join([*head, *rows, ""]).encode())
        clouds_of[name] = p
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        found = ply.read(spark, [(f"{tmp_path}/*.ply", "both"), (f"{tmp_path}/b.ply", "again")])
        assert spark.read.text(f"{tmp_path}/a.ply").rdd.getNumPartitions() > 10
        rows = found.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    both = sorted([(i, *p) for c in clouds_of.values() for i, p in enumerate(c.tolist())])
    assert sorted((x.point_id, x.x, x.y, x.z) for x in rows if x["name"] == "both") == [(i, *p) for i, *p in both]
    assert sorted((x.point_id, x.x, x.y, x.z) for x in rows if x["name"] == "again") == [(i, *p) for i, p in enumerate(clouds_of["b"].tolist())]


def test_ply_of_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ply, "FILE_POINTS", 30)
    c = generators.cube(spark, 100)
    ply.write(c, str(tmp_path / "many"))
    assert len(list((tmp_path / "many").glob("part-*"))) > 1
    got = ply.read(spark, f"{tmp_path}/many/part-*").toPandas().sort_values("point_id")
    want = c.toPandas().sort_values("point_id")
    assert list(got.point_id) == list(range(100)) and np.allclose(got[["x", "y", "z"]], want[["x", "y", "z"]])
    ply.write(c.limit(0), str(tmp_path / "none"))
    assert ply.read(spark, f"{tmp_path}/none/part-*").count() == 0


def test_draws_agree_with_spark(spark):
    want = ransac.draws(42, np.array([3]), 50)[0]
    got = [r[0] for r in spark.range(50).select(uniform(42, 3, F.col("id"))).collect()]
    assert np.allclose(got, want, rtol=0, atol=1e-15)
    u = ransac.draws(1, np.arange(200), 200).ravel()
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() * 12 - 1) < 0.02


def test_generators(spark):
    cube = generators.cube(spark, 600).toPandas()[["x", "y", "z"]].to_numpy()
    assert np.allclose(np.abs(cube).max(1), 1)
    cyl = generators.cylinder(spark, 500).toPandas()
    r = np.hypot(cyl.x, cyl.y)
    assert sorted(cyl.point_id) == list(range(500)) and ((np.isclose(np.abs(cyl.z), 1) & (r <= 1 + 1e-9)) | np.isclose(r, 1)).all()
    hexa = generators.hexagon_prism(spark, 600).toPandas()[["x", "y", "z"]].to_numpy()
    apothem = np.max([np.abs(hexa[:, 0] * np.cos(a) + hexa[:, 1] * np.sin(a)) for a in np.deg2rad([30, 90, 150])], axis=0)
    assert (np.isclose(np.abs(hexa[:, 2]), 1) | np.isclose(apothem, np.sqrt(3) / 2)).all() and (apothem <= np.sqrt(3) / 2 + 1e-9).all()
    e = {m: generators.ellipsoid(spark, 700, 1.0, 1.0, 3.0, mode=m).toPandas() for m in ("reference", "area")}
    for own in e.values():
        assert len(own) == 700 and np.allclose(own.x**2 + own.y**2 + own.z**2 / 9, 1)
    assert (e["reference"].z.abs() > 1.5).mean() < 0.08 and (e["area"].z.abs() > 1.5).mean() > 0.33
    for bad in (lambda: generators.cube(spark, 0), lambda: generators.ellipsoid(spark, 5, 0, 1, 1), lambda: generators.sphere(spark, 2.5)):
        with pytest.raises(ValueError):
            bad()


def test_sketches_bound_ranks_and_merge(spark):
    """Over many cuts of a skewed, tied column the order statistic lies within the sketch's interval; sketches of parts merge in any order."""
    from sphaera.functions.portable import MARGIN, RANK_ERROR, SKETCH_K

    n = 200_000
    rows = spark.range(n).select((F.floor(F.exp(uniform(3, 0, F.col("id")) * 12)) + F.col("id") % 3).alias("v"), (F.col("id") % 7).alias("part"))
    exact = np.sort(np.array([r[0] for r in rows.select("v").collect()], float))
    parts = rows.groupBy("part").agg(F.kll_sketch_agg_double(F.col("v").cast("double"), SKETCH_K).alias("s"))
    for order in ("part", F.desc("part"), F.hash("part")):
        merged = parts.orderBy(order).coalesce(1).agg(F.kll_merge_agg_double("s").alias("s"))
        shares = [0.01, 0.25, 0.5, 0.9, 0.998]
        found = merged.select(*[F.kll_sketch_get_quantile_double("s", F.lit(p)).alias(f"q{k}") for k, p in enumerate(shares)]).first()
        for p, x in zip(shares, found, strict=True):
            low, high = np.searchsorted(exact, x, "left") / n, np.searchsorted(exact, x, "right") / n
            assert low - MARGIN * RANK_ERROR <= p <= high + MARGIN * RANK_ERROR
    got = hazen(rows, [], "v", [1, 50, 99.8, 100]).first()
    assert np.allclose(got, [np.percentile(exact, p, method="hazen") for p in (1, 50, 99.8, 100)])


def test_percentiles_are_hazen(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in range(1, 11)] + [(2, 5.0), (1, float("nan")), (3, None)], "k int, v double")
    found = {r.k: (r.p50, r.p95, r.p100) for r in hazen(rows, ["k"], "v", [50, 95, 100]).collect()}
    assert found == {1: (5.5, 10.0, 10.0), 2: (5.0, 5.0, 5.0)}


def test_percentiles_of_many_ties_and_keys(spark):
    n = 4000
    v = np.where(R.random(n) < 0.5, 1.25, R.lognormal(size=n) ** 3)
    rows = spark.createDataFrame([(int(i % 3 > 0), float(x)) for i, x in enumerate(v)], "k int, v double")
    for keys in ([], ["k"]):
        found = {r[0] if keys else None: tuple(r)[len(keys) :] for r in hazen(rows, keys, "v", [1, 33.3, 50, 99.8]).collect()}
        for key, got in found.items():
            own = np.sort(v if key is None else v[(np.arange(n) % 3 > 0).astype(int) == key])
            assert np.allclose(got, np.percentile(own, [1, 33.3, 50, 99.8], method="hazen"), rtol=1e-12)
        assert len(found) == (2 if keys else 1)


def test_moving_average_is_the_recursion(spark):
    v = R.random(500)
    rows = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "k int, i int, v double")
    got = [r.w for r in analysis.moving_average(rows, ["k"], "i", "v", 0.65).orderBy("i").collect()]
    w, want = 0.65, []
    for x in v:
        w = 0.8 * w + 0.2 * x
        want.append(w)
    assert np.allclose(got, want, atol=1e-14)


def test_edges_of_implied_iterations(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "p double")
    got = {r.p: r.n for r in rows.select("p", analysis.iterations_for(rows.p, 0.95).alias("n")).collect()}
    assert got == {0.0: None, 1.0: 1.0, 0.5: 5.0}


@pytest.mark.parametrize("kind", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply(spark, tmp_path, kind):
    p = R.normal(size=(17, 3)).astype("f4")
    head = f"ply\nformat {kind} 1.0\ncomment x\nelement vertex 17\nproperty uchar red\nproperty float x\nproperty float y\nproperty float z\nelement face 0\nproperty list uchar int vertex_indices\nend_header\n"
    if kind == "ascii":
        body = "".join(f"7 {a!r} {b!r} {c!r}\n" for a, b, c in p.astype(float).tolist()).encode()
    else:
        e = "<" if "little" in kind else ">"
        t = np.zeros(17, [("r", "u1"), ("x", e + "f4"), ("y", e + "f4"), ("z", e + "f4")])
        t["x"], t["y"], t["z"] = p.T
        body = t.tobytes()
    (tmp_path / "a.ply").write_bytes(head.encode() + body)
    with pytest.warns(UserWarning, match="missing"):
        got = ply.read(spark, [(f"{tmp_path}/a.ply", "a"), (f"{tmp_path}/none.ply", "b")])
    got = got.orderBy("point_id").toPandas()
    assert set(got.name) == {"a"} and np.allclose(got[["x", "y", "z"]], p)
    with pytest.raises(ValueError):
        ply.parse(b"plain text")


def test_cloud_cleaning(spark):
    rows = [(0, 1.0, 2.0, 3.0), (1, float("nan"), 0.0, 0.0), (2, float("inf"), 0.0, 0.0), (3, None, 0.0, 0.0), (4, 3.0, 2.0, -1.0)]
    c = clouds.normalised(spark.createDataFrame(rows, "point_id bigint, x double, y double, z double"))
    assert {tuple(r) for r in c.collect()} == {(0, -0.5, 0.0, 1.0), (4, 0.5, 0.0, -1.0)}
    same = clouds.normalised(spark.createDataFrame(rows[:1] * 2, "point_id bigint, x double, y double, z double"))
    assert {tuple(r)[1:] for r in same.collect()} == {(0.0, 0.0, 0.0)}
    assert clouds.normalised(c.limit(0)).count() == 0


def test_tables(spark):
    g = tables.grid(spark, order=[4, 6], eps=[0.1, 0.2])
    assert sorted(map(tuple, g.collect())) == list(itertools.product([4, 6], [0.1, 0.2]))
    assert tables.has_columns(g, "eps") and not tables.has_columns(g, "raw_ms")
    assert tables.existing(spark, "no_such_results", "row_id int").count() == 0
    assert tables.output_path("out").startswith("out/20")


def test_stream(spark, tmp_path):
    rows = [(f"2024-01-{d:02d} 00:00:00", "a" if d % 2 else "b", float(d)) for d in range(1, 11)]
    src = spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("to_timestamp(ts) ts", "event_type", "value")
    src.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = log_stream.read_events(spark, f"{tmp_path}/in", src.schema)
    got = log_stream.run_to_table(log_stream.best_so_far(stream), "best_log", "complete", f"{tmp_path}/c1")
    assert {tuple(r) for r in got.collect()} == {("a", 5, 9.0), ("b", 5, 10.0)}
    windows = log_stream.run_to_table(log_stream.score_summary(log_stream.read_events(spark, f"{tmp_path}/in", src.schema, 9)), "windows_log", "append", f"{tmp_path}/c2")
    assert windows.count() >= 8


def test_solver_scores_all_points(spark, monkeypatch):
    cloud = generators.jittered(generators.sphere(spark, 400), 0.02, 5)
    far = cloud.select((F.col("point_id") + 400).alias("point_id"), *[(F.col(a) * 3).alias(a) for a in "xyz"], F.lit(False).alias("gt"))
    cloud = cloud.select("point_id", "x", "y", "z", F.lit(True).alias("gt")).unionByName(far)
    config = ransac.Config(order=2, k_mult=2.0, strength=1e-3, max_iter=30, thresh=0.3)
    monkeypatch.setattr(ransac, "BLOCK", 100)
    row = ransac.solve_cloud(cloud, config).first()
    assert row.tp + row.fp + row.fn + row.tn == 800
    p = cloud.toPandas()
    s = by_hand.Solver(config)
    r = s.residual(p[["x", "y", "z"]].to_numpy(float) - np.array(row.disp), np.array(row.beta))
    inside, truth = r < config.thresh, p["gt"].to_numpy(bool)
    assert np.allclose([row.inlier_ratio, row.post_score, row.mse_all, row.mse_inlier], [inside.mean(), s.score(r), (r**2).mean(), (r[inside] ** 2).mean()])
    assert (row.tp, row.fp) == ((truth & inside).sum(), (~truth & inside).sum())


def test_band_join_against_all_pairs(spark):
    """Tolerance look-ups at cell edges, with negative, null, NaN and infinite keys; the cells are keys of the join."""
    r, t = np.random.default_rng(6), {"eps": 0.01, "k": 0.3}
    value = lambda: float(r.choice([0.0, -0.02, 0.02, 0.02 * (1 + 1e-6), 0.01, 0.03, 1e9, r.normal(0, 0.05)]))
    odd = [None, float("nan"), float("inf"), -float("inf")]
    rows = lambda n: [(int(r.integers(2)), value(), float(r.integers(-3, 4)) / 10, i) for i in range(n)] + [(1, x, y, 1000 + i) for i, (x, y) in enumerate(itertools.product([0.0, *odd], odd))] + [(None, 0.0, 0.0, 2000)]
    results, wanted = rows(300), [w[:3] for w in rows(120)]
    right = spark.createDataFrame(results, "order int, eps double, k double, row long")
    left = spark.createDataFrame([(*w, f"n{i}") for i, w in enumerate(wanted)], "order int, eps double, k double, name string")
    near = lambda a, b, tol: a is not None and b is not None and abs(a - b) < tol
    want = {}
    for i, w in enumerate(wanted):
        own = [x[3] for x in results if w[0] is not None and w[0] == x[0] and near(w[1], x[1], t["eps"]) and near(w[2], x[2], t["k"])]
        want[f"n{i}"] = max(own) if own else None
    got = {x["name"]: x.r_row for x in analysis.look_up(left, right, ["order"], t, "row").collect()}
    assert got == {n: x for n, x in want.items() if x is not None}
    assert sorted(x["name"] for x in analysis.misses(left, right, ["order"], t).collect()) == sorted(n for n, x in want.items() if x is None)
    assert analysis.look_up(left, right, ["order"], {"eps": 0.0}, "row").count() == 0 and analysis.misses(left, right, ["order"], {"eps": 0.0}).count() == len(wanted)
    plan = analysis.look_up(left.hint("merge"), right, ["order"], t, "row")._jdf.queryExecution().executedPlan().toString()
    keys = next(line for line in plan.splitlines() if "SortMergeJoin" in line or "HashJoin" in line)
    assert all(f"__{s}{k}" in keys for s in "wr" for k in (0, 1))


def test_band_join_of_many_rows_of_one_order(spark):
    """200,000 by 200,000 rows of one order: some rows meet, not all pairs."""
    n = 200_000
    right = spark.range(n).select(F.lit(4).alias("order"), (F.col("id") * 0.001).alias("eps"), F.col("id").alias("row"))
    left = right.select("order", (F.col("eps") + 0.0004).alias("eps"))
    got = analysis.look_up(left, right, ["order"], {"eps": 0.0005}, "row")
    assert got.count() == n and got.filter(F.abs(F.col("eps") - F.col("r_eps")) >= 0.0005).count() == 0
    assert analysis.misses(left.limit(1000), right, ["order"], {"eps": 0.0005}).count() == 0
