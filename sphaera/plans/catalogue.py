"""Query catalogue: every operator as a Spark query, with DuckDB SQL beside it.

Sums in two engines run in different orders, so results are rounded to some
decimals before they are compared; see functions.portable.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.basis import Term, gradient_sql, harmonic_terms, monomial_terms, penalty, ridge_diagonal
from ..functions.portable import finite, half_up, hazen, hazen_sql, quantised, quantised_sql, uniform, uniform_sql
from ..functions.shared import work_path
from ..operators import analysis, linalg, mesh, moments, ransac, score, tables
from ..sources import clouds, generators, ply
from ..streaming import log_stream

Q = quantised_sql
THRESH, SIGMA = 0.45, 0.15
RIDGE = 0.002
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _ORACLE[key] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def q(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: quantised(F.col(n), digits) for n in names})


# --- clouds ---------------------------------------------------------------

_RAW = "SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label FROM embeddings"
_LINE = "SELECT l_orderkey * 8 + l_linenumber AS point_id, l_quantity / 50.0 AS x, l_discount / 0.1 + 0.0 AS y, l_tax / 0.08 + 0.0 AS z FROM lineitem"


def _normal(raw: str, keep: str = "") -> str:
    return f"""WITH raw AS ({raw}), fin AS (SELECT * FROM raw WHERE isfinite(x) AND isfinite(y) AND isfinite(z)),
mid AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM fin),
cen AS (SELECT point_id, x - cx AS x, y - cy AS y, z - cz AS z{keep} FROM fin, mid),
top AS (SELECT max(greatest(abs(x), abs(y), abs(z))) AS m FROM cen),
cloud AS (SELECT point_id, CASE WHEN m > 2.220446049250313E-16 THEN x / m ELSE x END AS x, CASE WHEN m > 2.220446049250313E-16 THEN y / m ELSE y END AS y, CASE WHEN m > 2.220446049250313E-16 THEN z / m ELSE z END AS z{keep} FROM cen, top)
"""


CLOUD, LINE_CLOUD = _normal(_RAW, ", label"), _normal(_LINE)


def cloud_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.normalised(clouds.from_embeddings(spark, sf_dir))


@query(CLOUD + f"SELECT point_id, {Q('x')} AS x, {Q('y')} AS y, {Q('z')} AS z FROM cloud")
def cloud_normalise(spark, sf):
    return q(cloud_of(spark, sf), "x", "y", "z").select("point_id", "x", "y", "z")


@query(LINE_CLOUD + "SELECT count(*) AS n_points, " + ", ".join(f"{Q(f'{f}({a})')} AS {a}_{f}" for a in "xyz" for f in ("min", "max")) + " FROM cloud")
def cloud_lineitem_stats(spark, sf):
    s = clouds.summary(clouds.normalised(clouds.from_lineitem(spark, sf)))
    return q(s, *[c for c in s.columns if c != "n_points"])


@query(f"WITH raw AS ({_RAW}), d AS (SELECT point_id % 7 AS k, x, y, z FROM raw WHERE point_id < 30), mid AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM d) SELECT point_id, {Q('x - cx')} AS x, {Q('y - cy')} AS y, {Q('z - cz')} AS z FROM raw, mid")
def centre_on_subset(spark, sf):
    """All points minus the centroid of a drawn subset."""
    c = clouds.from_embeddings(spark, sf)
    return q(clouds.centred(c, clouds.centroid(c.filter("point_id < 30"))), "x", "y", "z").select("point_id", "x", "y", "z")


@query(CLOUD + f"SELECT point_id, {Q('x - 0.12')} AS x, {Q('y + 0.07')} AS y, {Q('z - 0.2')} AS z FROM cloud")
def cloud_shift(spark, sf):
    return q(clouds.shifted(cloud_of(spark, sf), (0.12, -0.07, 0.20)), "x", "y", "z").select("point_id", "x", "y", "z")


@query(f"WITH raw AS ({_RAW}), n AS (SELECT max(point_id) + 1 AS n FROM raw) SELECT point_id, {Q('x')} AS x, {Q('y')} AS y, {Q('z')} AS z, true AS gt FROM raw UNION ALL SELECT point_id + n, {Q('x * 2')}, {Q('y * 2')}, {Q('z * 2')}, false FROM raw, n WHERE point_id < n // 4")
def pool_concat(spark, sf):
    """All points, and a quarter as many outliers; ids run from 0, so their number follows from the largest."""
    c = clouds.from_embeddings(spark, sf)
    n = (c.agg(F.max("point_id")).first()[0] or 0) + 1
    out = clouds.concatenated(c, c.withColumns({a: F.col(a) * 2 for a in "xyz"}), n, n // 4)
    return q(out, "x", "y", "z").select("point_id", "x", "y", "z", "gt")


@query(f"SELECT vec_id AS point_id, {Q('CAST(embedding[1] AS DOUBLE)')} AS x, {Q('CAST(embedding[2] AS DOUBLE)')} AS y, {Q('CAST(embedding[3] AS DOUBLE)')} AS z FROM embeddings")
def ply_roundtrip(spark, sf):
    """The cloud written as PLY and scanned again."""
    path = work_path(spark, "ply")
    ply.write(clouds.from_embeddings(spark, sf), path)
    return q(ply.read(spark, f"{path}/part-*"), "x", "y", "z").select("point_id", "x", "y", "z")


@query(f"SELECT name, row_number() OVER (PARTITION BY name ORDER BY point_id) - 1 AS point_id, {Q('x')} AS x, {Q('y')} AS y, {Q('z')} AS z FROM (SELECT *, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS name FROM ({_RAW}))")
def ply_manifest(spark, sf):
    """Two files of a manifest and a third one that is missing."""
    c, files = clouds.from_embeddings(spark, sf), []
    for name, part in (("low", c.filter("label < 5")), ("high", c.filter("label >= 5"))):
        path = work_path(spark, f"ply-{name}")
        ply.write(part, path)
        files.append((f"{path}/part-*", name))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = ply.read(spark, [*files, (work_path(spark, "ply-none"), "none")])
    return q(found, "x", "y", "z").select("name", "point_id", "x", "y", "z")


@query(f"SELECT label, count(*) AS n_view, {Q('sum(CAST(embedding[1] AS DOUBLE))', 4)} AS sum_x, true AS none_is_none FROM embeddings GROUP BY label")
def catalog_views(spark, sf):
    """A cloud registered under a name, probed and read back."""
    clouds.register(clouds.from_embeddings(spark, sf), "sphaera_cloud")
    none = clouds.lookup(spark, "sphaera_no_such_cloud") is None
    found = clouds.lookup(spark, "sphaera_cloud").groupBy("label").agg(F.count("*").alias("n_view"), F.sum("x").alias("sum_x"))
    return q(found, "sum_x", digits=4).withColumn("none_is_none", F.lit(none))


@query(f"WITH log AS (SELECT event_type AS config, max(value / 500.0) AS best FROM events GROUP BY event_type), two AS (SELECT 'a' AS run, config, best FROM log UNION ALL SELECT 'b', config, best / 2 FROM log) SELECT CAST(row_number() OVER (ORDER BY run, config) AS BIGINT) AS row_id, run, config, {Q('best')} AS best FROM two")
def result_append(spark, sf):
    """Two runs added to a table that survives re-runs, one of them twice: numbers go on, no row comes twice."""
    path = work_path(spark, "results")
    best = log_of(spark, sf).groupBy("config").agg(F.max("score").alias("best"))
    for name, part in (("a", best), ("b", best), ("b", best.withColumn("best", F.col("best") / 2))):
        tables.append_results(part, path, name)
    return q(tables.read_results(spark, path, "config string, best double", ["config"]), "best")


# --- bases and sums -------------------------------------------------------


def _basis_query(terms: tuple[Term, ...]) -> Callable:
    def run(spark, sf):
        c = cloud_of(spark, sf)
        parts = [[t.sql() for t in terms], *gradient_sql(terms)]
        names = ("avg_phi", "avg_dx", "avg_dy", "avg_dz")
        one = c.agg(*[F.avg(F.expr(e)).alias(f"{n}{k}") for n, p in zip(names, parts) for k, e in enumerate(p)])
        cells = [F.struct(F.lit(k).alias("term"), *[quantised(F.col(f"{n}{k}")).alias(n) for n in names]) for k in range(len(terms))]
        return one.select(F.inline(F.array(*cells)))

    return run


def _basis_sql(terms: tuple[Term, ...]) -> str:
    parts = [[t.sql() for t in terms], *gradient_sql(terms)]
    rows = [f"SELECT {k} AS term, " + ", ".join(f"{Q(f'avg({p[k]})')} AS {n}" for n, p in zip(("avg_phi", "avg_dx", "avg_dy", "avg_dz"), parts)) + " FROM cloud" for k in range(len(terms))]
    return CLOUD + " UNION ALL ".join(rows)


for _o in (2, 4, 6):
    query(_basis_sql(harmonic_terms(_o)), f"basis_o{_o}")(_basis_query(harmonic_terms(_o)))
query(_basis_sql(monomial_terms(3)), "basis_monomials")(_basis_query(monomial_terms(3)))


def _gram_sql(cloud: str, terms: tuple[Term, ...]) -> str:
    n = len(terms)
    phi = f", phi AS (SELECT {', '.join(f'{t.sql()} AS p{k}' for k, t in enumerate(terms))} FROM cloud)"
    cells = [f"SELECT {i} AS i, {j} AS j, {Q(f'sum(p{i} * p{j})', 4)} AS value FROM phi" for i in range(n) for j in range(i, n)]
    cells += [f"SELECT {i}, -1, {Q(f'sum(p{i})', 4)} FROM phi" for i in range(n)] + ["SELECT -1, -1, CAST(count(*) AS DOUBLE) FROM phi"]
    return cloud + phi + " " + " UNION ALL ".join(cells)


def _gram_query(source: Callable, order: int) -> Callable:
    return lambda spark, sf: q(linalg.gram(clouds.normalised(source(spark, sf)), harmonic_terms(order)), "value", digits=4)


query(_gram_sql(CLOUD, harmonic_terms(2)), "gram_o2")(_gram_query(clouds.from_embeddings, 2))
query(_gram_sql(CLOUD, harmonic_terms(4)), "gram_o4")(_gram_query(clouds.from_embeddings, 4))
query(_gram_sql(CLOUD, harmonic_terms(6)), "gram_o6")(_gram_query(clouds.from_embeddings, 6))
query(_gram_sql(LINE_CLOUD, harmonic_terms(2)), "gram_lineitem_o2")(_gram_query(clouds.from_lineitem, 2))


def _eliminated(n: int, rhs: str = "b") -> str:
    """CTEs that solve the n x n system in table s (a0_0 ..., b0 ...): pivot after pivot, into table beta."""
    out, at = "", "s"
    for k in range(n):
        cols = []
        for i in range(n):
            for j in range(n):
                cols.append(f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * (a{k}_{j} / a{k}_{k}) AS a{i}_{j}")
            cols.append(f"b{k} / a{k}_{k} AS b{k}" if i == k else f"b{i} - a{i}_{k} * (b{k} / a{k}_{k}) AS b{i}")
        out += f", e{k} AS (SELECT {', '.join(cols)} FROM {at})"
        at = f"e{k}"
    return out + f", beta AS (SELECT {', '.join(f'b{i}' for i in range(n))} FROM {at})"


def _fit_ctes(strength: float, weights: np.ndarray | None, order: int = 2, cloud: str | None = None) -> str:
    terms = harmonic_terms(order)
    n = len(terms)
    w = np.ones(n) if weights is None else weights
    phi = f", phi AS (SELECT {', '.join(f'{t.sql()} AS p{k}' for k, t in enumerate(terms))} FROM cloud)"
    cells = [f"sum(p{i} * p{j})" + (f" + count(*) * {strength * w[i]:.17E}" if i == j and strength else "") + f" AS a{i}_{j}" for i in range(n) for j in range(n)]
    return (cloud or CLOUD) + phi + f", s AS (SELECT {', '.join(cells + [f'sum(p{i}) AS b{i}' for i in range(n)])} FROM phi)" + _eliminated(n)


def _beta_rows(spark: SparkSession, beta: np.ndarray | None, digits: int = 5) -> DataFrame:
    rows = [] if beta is None else [(k, float(np.floor(b * 10**digits + 0.5) / 10**digits) + 0.0) for k, b in enumerate(beta)]
    return spark.createDataFrame(rows, "term int, beta double")


def _fit_query(strength: float, order: int | None, degree: int = 2) -> Callable:
    return lambda spark, sf: _beta_rows(spark, linalg.fit(cloud_of(spark, sf), harmonic_terms(degree), strength, order))


_BETA_ROWS = " UNION ALL ".join(f"SELECT {k} AS term, {Q(f'b{k}', 5)} AS beta FROM beta" for k in range(6))
_SOBOLEV = penalty(harmonic_terms(2), 2)
for _name, _l, _w, _ord in (("fit_o2_ols", 0.0, None, None), ("fit_o2_iso", RIDGE, None, None), ("fit_o2_sobolev", RIDGE, _SOBOLEV, 2)):
    query(_fit_ctes(_l, _w) + _BETA_ROWS, _name)(_fit_query(_l, _ord))
query(_fit_ctes(RIDGE, penalty(harmonic_terms(4), 4), 4) + " UNION ALL ".join(f"SELECT {k} AS term, {Q(f'b{k}', 4)} AS beta FROM beta" for k in range(15)), "fit_o4")(
    lambda spark, sf: _beta_rows(spark, linalg.fit(cloud_of(spark, sf), harmonic_terms(4), RIDGE, 4), 4)
)
query(None, "fit_o6")(lambda spark, sf: _beta_rows(spark, linalg.fit_qr(cloud_of(spark, sf), harmonic_terms(6), RIDGE, 6)))
_FIT = _fit_ctes(RIDGE, _SOBOLEV)
_F = "(" + " + ".join(f"b{k}*{t.sql()}" for k, t in enumerate(harmonic_terms(2))) + ")"
_G = ["(" + " + ".join(f"b{k}*{e}" for k, e in enumerate(axis)) + ")" for axis in gradient_sql(harmonic_terms(2))]


def _fitted(spark, sf) -> tuple[DataFrame, tuple[Term, ...], np.ndarray]:
    c, terms = cloud_of(spark, sf), harmonic_terms(2)
    return c, terms, linalg.fit(c, terms, RIDGE, 2)


@query()
def spectrum(spark, sf):
    """Eigenvalues of the order 4 Gram matrix over the rows, largest first, and their condition number."""
    ev = linalg.spectrum_qr(cloud_of(spark, sf), harmonic_terms(4))
    return q(spark.createDataFrame([(k, float(v), float(ev[0] / ev[-1])) for k, v in enumerate(ev)], "rank int, eigenvalue double, condition double"), "eigenvalue", "condition", digits=5)


@query(CLOUD + f", phi AS (SELECT {', '.join(f'{t.sql()} AS p{k}' for k, t in enumerate(harmonic_terms(4)))} FROM cloud), g AS (SELECT count(*) AS n, {', '.join(f'avg(p{i} * p{j}) AS g{i}_{j}' for i in range(15) for j in range(i, 15))} FROM phi) SELECT {Q(' + '.join(f'g{i}_{i}' for i in range(15)), 5)} AS total, {Q(' + '.join(f'{1 if i == j else 2} * g{i}_{j} * g{i}_{j}' for i in range(15) for j in range(i, 15)), 5)} AS squares FROM g")
def spectrum_moments(spark, sf):
    """Sums of the eigenvalues and of their squares: trace and squared norm of the matrix."""
    ev = linalg.Gram.collect(linalg.gram(cloud_of(spark, sf), harmonic_terms(4)), 15).spectrum()
    return q(spark.createDataFrame([(float(ev.sum()), float((ev**2).sum()))], "total double, squares double"), "total", "squares", digits=5)


@query()
def shrinkage(spark, sf):
    ev = linalg.spectrum_qr(cloud_of(spark, sf), harmonic_terms(4))
    rows = linalg.shrinkage(ev, [0.0] + [10.0**k for k in range(-6, 6)])
    return spark.createDataFrame(rows, "strength double, least double, median double, largest double")


_D = _FIT + f""", g AS (SELECT {_G[0]} AS gx, {_G[1]} AS gy, {_G[2]} AS gz, 1.0 - {_F} AS e FROM cloud, beta),
m AS (SELECT sum(gx*gx) AS a, sum(gx*gy) AS b, sum(gx*gz) AS c, sum(gy*gy) AS d, sum(gy*gz) AS f, sum(gz*gz) AS h, sum(gx*e) AS p, sum(gy*e) AS r, sum(gz*e) AS t FROM g),
det AS (SELECT *, a*(d*h-f*f) - b*(b*h-c*f) + c*(b*f-c*d) AS w FROM m)
SELECT {Q('((d*h-f*f)*p + (c*f-b*h)*r + (b*f-c*d)*t) / w')} AS dx, {Q('((c*f-b*h)*p + (a*h-c*c)*r + (b*c-a*f)*t) / w')} AS dy, {Q('((b*f-c*d)*p + (b*c-a*f)*r + (a*d-b*b)*t) / w')} AS dz FROM det"""


@query(_D)
def shift_step(spark, sf):
    return q(linalg.shift_step(*_fitted(spark, sf)), "dx", "dy", "dz")


_SCORED = _FIT + f", r AS (SELECT point_id, label, x, y, z, abs({_F} - 1.0) AS r FROM cloud, beta), sc AS (SELECT *, exp(-(r*r) / {2 * SIGMA * SIGMA!r}) AS soft, r < {THRESH} AS inlier FROM r) "


def _scored(spark, sf) -> DataFrame:
    return score.with_residual(*_fitted(spark, sf), THRESH, SIGMA)


@query(_SCORED + f"SELECT count(*) AS n_points, count(*) FILTER (inlier) AS n_inliers, {Q('avg(CAST(inlier AS DOUBLE))')} AS inlier_ratio, {Q('avg(soft)')} AS soft_score, {Q('avg(r*r)')} AS mse_all, {Q('avg(r*r) FILTER (inlier)')} AS mse_inlier, {Q('sum(CASE WHEN inlier THEN soft ELSE 0 END) / sum(soft)')} AS inlier_mass FROM sc")
def residual_score(spark, sf):
    s = score.statistics(_scored(spark, sf), F.col("soft"))
    return q(s, "inlier_ratio", "soft_score", "mse_all", "mse_inlier", "inlier_mass")


@query(_SCORED + f"SELECT point_id, {Q('r')} AS r, {Q('soft')} AS soft, inlier, r <= {THRESH} AS inlier_or_on FROM sc")
def soft_weight(spark, sf):
    s = _scored(spark, sf).withColumn("inlier_or_on", F.col("r") <= THRESH)
    return q(s, "r", "soft").select("point_id", "r", "soft", "inlier", "inlier_or_on")


@query(_FIT + f", d AS (SELECT 1 AS k, ({_F} - 1.0) / sqrt(greatest(1E-12, {_G[0]}*{_G[0]} + {_G[1]}*{_G[1]} + {_G[2]}*{_G[2]})) AS sdf FROM cloud, beta), p AS ({hazen_sql('(SELECT k, abs(sdf) AS a FROM d)', 'k', 'a', [50, 95, 100])}) SELECT (SELECT {Q('sqrt(avg(sdf*sdf))')} FROM d) AS rms, {Q('p50')} AS p50, {Q('p95')} AS p95, {Q('p100')} AS p100 FROM p")
def sdf(spark, sf):
    """Root mean square and percentiles of the first-order signed distance."""
    d = score.with_distance(*_fitted(spark, sf)).withColumn("a", F.abs("sdf"))
    p = hazen(d, [], "a", [50, 95, 100])
    return q(d.agg(F.sqrt(F.avg(F.col("sdf") * F.col("sdf"))).alias("rms")).join(F.broadcast(p)), "rms", "p50", "p95", "p100")


def _model_sql(k: int, strength: float, weights: np.ndarray | None) -> str:
    r = f"abs({_F} - 1.0)"
    return f"SELECT * FROM ({_fit_ctes(strength, weights)} SELECT {k} AS model_id, count(*) AS n_points, {Q(f'avg(exp(-({r}*{r}) / {2 * SIGMA * SIGMA!r}))', 5)} AS soft_score, {Q(f'avg(CAST({r} < {THRESH} AS DOUBLE))', 5)} AS inlier_ratio, {Q(f'avg({r}*{r})', 5)} AS mse_all FROM cloud, beta)"


_MODELS = ((0.0, None, None), (RIDGE, None, None), (RIDGE, _SOBOLEV, 2))


@query(" UNION ALL ".join(_model_sql(k, v, w) for k, (v, w, _) in enumerate(_MODELS)))
def score_models(spark, sf):
    """Several models scored on one cloud in one pass."""
    c, terms = cloud_of(spark, sf), harmonic_terms(2)
    models = [(k, np.zeros(3), linalg.fit(c, terms, v, o)) for k, (v, _, o) in enumerate(_MODELS)]
    return q(score.score_models(c, terms, models, THRESH, SIGMA), "soft_score", "inlier_ratio", "mse_all", digits=5)


_PRF = f"tp, fp, fn, tn, {Q('CAST(tp AS DOUBLE) / greatest(1, tp + fp)')} AS precision, {Q('CAST(tp AS DOUBLE) / greatest(1, tp + fn)')} AS recall, {Q('CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END')} AS f1"


@query(f"WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels) SELECT {_PRF} FROM c")
def confusion_prf(spark, sf):
    la = spark.read.parquet(f"{sf}/labels.parquet")
    return q(score.confusion(la, F.col("quality") == 1, F.col("toxic") == 1), "precision", "recall", "f1")


@query(_SCORED + f", c AS (SELECT label, count(*) FILTER (label >= 5 AND inlier) AS tp, count(*) FILTER (label < 5 AND inlier) AS fp, count(*) FILTER (label >= 5 AND NOT inlier) AS fn, count(*) FILTER (label < 5 AND NOT inlier) AS tn FROM sc GROUP BY label) SELECT label, {_PRF} FROM c")
def confusion_by_label(spark, sf):
    return q(score.confusion(_scored(spark, sf), F.col("label") >= 5, F.col("inlier"), ["label"]), "precision", "recall", "f1")


@query(_FIT + f"SELECT {Q(' + '.join(f'b{k}*b{k}' for k in range(6)), 4)} AS beta_norm FROM beta")
def beta_norm(spark, sf):
    _, _, beta = _fitted(spark, sf)
    one = spark.range(1).select(F.array(*[F.lit(float(b)) for b in beta]).alias("beta"))
    return q(one.select(score.squared_norm(F.col("beta")).alias("beta_norm")), "beta_norm", digits=4)


def _named_fit(name: str, points: str, strength: float = 0.0, weights: np.ndarray | None = None) -> str:
    """beta_<name>: an order 2 fit through a table of points."""
    terms = harmonic_terms(2)
    n = len(terms)
    w = np.ones(n) if weights is None else weights
    phi = f", phi_{name} AS MATERIALIZED (SELECT {', '.join(f'{t.sql()} AS p{k}' for k, t in enumerate(terms))} FROM {points})"
    cells = [f"sum(p{i} * p{j})" + (f" + count(*) * {strength * w[i]:.17E}" if i == j and strength else "") + f" AS a{i}_{j}" for i in range(n) for j in range(n)]
    own = _eliminated(n).replace("FROM s)", f"FROM s_{name})").replace("beta AS", f"beta_{name} AS MATERIALIZED")
    for k in range(n):
        own = own.replace(f" e{k} AS", f" e{k}_{name} AS").replace(f"FROM e{k})", f"FROM e{k}_{name})")
    return phi + f", s_{name} AS MATERIALIZED (SELECT {', '.join(cells + [f'sum(p{i}) AS b{i}' for i in range(n)])} FROM phi_{name})" + own


def _refine_ctes(name: str, points: str, steps: int, momentum: float, damping: float, strength: float = 0.0, weights: np.ndarray | None = None) -> str:
    """disp_<name> (dx, dy, dz) and beta_<name><steps>: the shifts of moments.refine written out, a fit, its gradients and a 3 x 3 solve for each step."""
    out = f", start_{name} AS (SELECT avg(x) AS sx, avg(y) AS sy, avg(z) AS sz FROM {points}), p_{name}0 AS (SELECT x - sx AS x, y - sy AS y, z - sz AS z FROM {points}, start_{name}), v_{name}0 AS (SELECT 0.0 AS vx, 0.0 AS vy, 0.0 AS vz, 0.0 AS tx, 0.0 AS ty, 0.0 AS tz)"
    for step in range(steps + 1):
        at = f"{name}{step}"
        out += _named_fit(at, f"p_{at}", strength, weights)
        if step == steps:
            break
        out += f", g_{at} AS (SELECT {_G[0]} AS gx, {_G[1]} AS gy, {_G[2]} AS gz, 1.0 - {_F} AS e FROM p_{at}, beta_{at})"
        out += f", m_{at} AS MATERIALIZED (SELECT sum(gx*gx) AS a, sum(gx*gy) AS b, sum(gx*gz) AS c, sum(gy*gy) AS d, sum(gy*gz) AS f, sum(gz*gz) AS h, sum(gx*e) AS p, sum(gy*e) AS r, sum(gz*e) AS t FROM g_{at}), w_{at} AS (SELECT *, a*(d*h-f*f) - b*(b*h-c*f) + c*(b*f-c*d) AS w FROM m_{at})"
        solved = ("((d*h-f*f)*p + (c*f-b*h)*r + (b*f-c*d)*t) / w", "((c*f-b*h)*p + (a*h-c*c)*r + (b*c-a*f)*t) / w", "((b*f-c*d)*p + (b*c-a*f)*r + (a*d-b*b)*t) / w")
        speed = [f"{momentum!r} * v{a} + {damping!r} * ({e})" for a, e in zip("xyz", solved)]
        to = f"{name}{step + 1}"
        out += f", u_{at} AS (SELECT {', '.join(f'{e} AS v{a}' for a, e in zip('xyz', speed))}, tx, ty, tz FROM w_{at}, v_{at}), v_{to} AS MATERIALIZED (SELECT vx, vy, vz, {', '.join(f't{a} - v{a} AS t{a}' for a in 'xyz')} FROM u_{at}), p_{to} AS MATERIALIZED (SELECT {', '.join(f'{a} + v{a} AS {a}' for a in 'xyz')} FROM p_{at}, v_{to})"
    return out + f", disp_{name} AS (SELECT {', '.join(f't{a} + s{a} AS d{a}' for a in 'xyz')} FROM v_{name}{steps}, start_{name})"


_NORM = " + ".join(f"b{k}*b{k}" for k in range(6))


@query(
    CLOUD + ", moved AS (SELECT x - 0.12 AS x, y + 0.07 AS y, z - 0.2 AS z FROM cloud)" + _refine_ctes("r", "moved", 4, 0.66, 0.85)
    + f" SELECT {', '.join(f'{Q(f"d{a}", 5)} AS d{a}' for a in 'xyz')}, {Q(_NORM, 4)} AS beta_norm FROM disp_r, beta_r4"
)
def local_refine_o2(spark, sf):
    """Four shifts with momentum from an off-centre start; the finite number of steps is part of the result. One pass takes the moments, all steps come from them."""
    m = moments.Moments.of_cloud(clouds.shifted(cloud_of(spark, sf), (0.12, -0.07, 0.20)), 4)
    disp, beta = moments.refine(m, harmonic_terms(2), 4, 0.66, 0.85)
    out = q(spark.createDataFrame([(*map(float, disp), float(beta @ beta))], "dx double, dy double, dz double, beta_norm double"), "dx", "dy", "dz", digits=5)
    return q(out, "beta_norm", digits=4)


_SWEEP = [0.0, *[10.0**k for k in range(-3, 4)], 2e-3, 3e-2, 5e-1, 30.0]


@query(" UNION ALL ".join(f"SELECT * FROM ({_fit_ctes(v, _SOBOLEV)} SELECT CAST({v!r} AS DOUBLE) AS strength, {Q(' + '.join(f'b{k}*b{k}' for k in range(6)), 4)} AS beta_norm, {Q(f'avg(({_F} - 1.0) * ({_F} - 1.0))', 4)} AS mse FROM cloud, beta GROUP BY {', '.join(f'b{k}' for k in range(6))})" for v in _SWEEP))
def lambda_sweep_o2(spark, sf):
    """One Gram matrix, twelve ridge strengths: coefficient norms and residuals."""
    return q(_sweep(spark, sf, 2).drop("singular"), "beta_norm", "mse", digits=4)


def _sweep(spark, sf, order: int) -> DataFrame:
    c, terms = cloud_of(spark, sf), harmonic_terms(order)
    r, n = linalg.triangle(c, terms)
    rows = []
    for v in _SWEEP:
        b = linalg.solve_triangle(r, n, v, penalty(terms, order))
        rest = None if b is None else r[:, :-1] @ b - r[:, -1]
        rows.append((float(v), b is None, float("nan") if b is None else float(b @ b), float("nan") if b is None else float(rest @ rest / n)))
    return spark.createDataFrame(rows, "strength double, singular boolean, beta_norm double, mse double")


@query()
def lambda_sweep(spark, sf):
    """The same at order 6, beyond what SQL solves."""
    return q(_sweep(spark, sf, 6), "beta_norm", "mse", digits=4)


def _lattice_sql(extent: float, density: int) -> str:
    step = 2 * extent / density
    terms = harmonic_terms(2)
    corner = lambda a, b, c: "(" + " + ".join(f"b{k}*{t.sql(f'((i + {a}) * {step!r} - {extent!r})', f'((j + {b}) * {step!r} - {extent!r})', f'((k + {c}) * {step!r} - {extent!r})')}" for k, t in enumerate(terms)) + " - 1.0)"
    values = [corner(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    axes = ", ".join(f"(SELECT unnest(range(0, {density})) AS {n}) t{n}" for n in "ijk")
    return _FIT + f", cells AS (SELECT i, j, k, {', '.join(f'{v} AS f{n}' for n, v in enumerate(values))} FROM {axes}, beta) SELECT i, j, k FROM cells WHERE least({', '.join(f'f{n}' for n in range(8))}) <= 0 AND greatest({', '.join(f'f{n}' for n in range(8))}) >= 0"


@query(_lattice_sql(1.2, 24))
def surface_lattice(spark, sf):
    """Lattice cells that the fitted surface passes through."""
    _, terms, beta = _fitted(spark, sf)
    return score.lattice(spark, terms, beta, 1.2, 24)


def _mesh_sql(extent: float, levels: int) -> str:
    """Every edge of the lattice's tetrahedra on which f - 1 changes sign, and the place between its ends."""
    n = 1 << levels
    step = 2 * extent / n
    at = lambda c, d: f"(({c} + {d}) * {step!r} - {extent!r})"
    f = lambda d: "(" + " + ".join(f"b{k}*{t.sql(*[at(c, x) for c, x in zip('ijk', d)])}" for k, t in enumerate(harmonic_terms(2))) + " - 1.0)"
    ways = [(m >> 2 & 1, m >> 1 & 1, m & 1) for m in range(1, 8)]
    axes = ", ".join(f"(SELECT unnest(range(0, {n + 1})) AS {c}) t{c}" for c in "ijk")
    edge = lambda m, d: f"SELECT {m} AS way, i, j, k, {d[0]} AS di, {d[1]} AS dj, {d[2]} AS dk, {f((0, 0, 0))} AS v, {f(d)} AS w FROM grid, beta WHERE i + {d[0]} <= {n} AND j + {d[1]} <= {n} AND k + {d[2]} <= {n}"
    place = lambda c: Q(f"({c} + v / (v - w) * d{c}) * {step!r} - {extent!r}", 5)
    return _FIT + f", grid AS (SELECT i, j, k FROM {axes}), ed AS ({' UNION ALL '.join(edge(4 * d[0] + 2 * d[1] + d[2], d) for d in ways)}) SELECT CAST(((i * {n + 1} + j) * {n + 1} + k) * 8 + way AS BIGINT) AS vertex_id, {place('i')} AS x, {place('j')} AS y, {place('k')} AS z FROM ed WHERE (v < 0) <> (w < 0)"


@query(_mesh_sql(1.2, 4))
def surface_mesh(spark, sf):
    """Vertices of the fitted surface's triangles."""
    _, terms, beta = _fitted(spark, sf)
    return q(mesh.vertices(mesh.triangles(spark, terms, beta, 1.2, 4)), "x", "y", "z", digits=5)


@query()
def mesh_report(spark, sf):
    """Sizes, Euler number, area and volume of the fitted surface at 64 cells an axis."""
    _, terms, beta = _fitted(spark, sf)
    return q(mesh.report(mesh.triangles(spark, terms, beta, 1.2, 6)), "area", "volume", digits=4)


@query(f"SELECT r_regionkey AS level_no, {Q('(6 - 2 * r_regionkey) * (7 - 2 * r_regionkey) / 42.0')} AS weight, {Q('(6 - 2 * r_regionkey) * (7 - 2 * r_regionkey) / 42.0')} AS first_weight, CAST(4 - r_regionkey AS DOUBLE) AS manual, CAST(13 - 4 * r_regionkey AS BIGINT) AS n FROM region WHERE r_regionkey <= 3")
def penalty_diagonal(spark, sf):
    """Sobolev penalty of order 6 by level, from the term vector and from the basis, and one value for each level; level numbers come from a table."""
    diagonals = ridge_diagonal(6, 1.0), penalty(harmonic_terms(6), 6), ridge_diagonal(6, [4.0, 3.0, 2.0, 1.0])
    level = np.repeat(range(4), [13, 9, 5, 1])
    rows = spark.createDataFrame([(int(k), *[float(d[i]) for d in diagonals]) for i, k in enumerate(level)], "level_no int, weight double, first_weight double, manual double")
    levels = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").alias("level_no"))
    found = rows.groupBy("level_no").agg(*[F.max(c).alias(c) for c in ("weight", "first_weight", "manual")], F.count("*").alias("n"))
    return q(levels.join(found, "level_no"), "weight", "first_weight")


# --- grids and logs -------------------------------------------------------

_GRID = "SELECT o AS \"order\", eps, k_mult FROM (SELECT unnest([4, 6]) AS o), (SELECT unnest([0.0, 0.1, 0.2, 0.3]) AS eps), (SELECT unnest([0.8, 1.2, 1.4]) AS k_mult)"


def _grid(spark) -> DataFrame:
    return tables.grid(spark, order=[4, 6], eps=[0.0, 0.1, 0.2, 0.3], k_mult=[0.8, 1.2, 1.4])


@query(f"WITH g AS ({_GRID}), s AS (SELECT *, CAST(floor(k_mult * ((\"order\" + 1) * (\"order\" + 2) / 2) + 0.5) AS BIGINT) AS k, 1.0 - eps AS w FROM g) SELECT \"order\", CAST(eps AS DOUBLE) AS eps, CAST(k_mult AS DOUBLE) AS k_mult, k, {Q('pow(w, k)')} AS wk, CAST(ceil(ln(1 - CAST(0.95 AS DOUBLE)) / ln(greatest(2.2250738585072014E-308, 1.0 - pow(w, k)))) AS DOUBLE) AS n_theory FROM s")
def grid_n_theory(spark, sf):
    """Sample size, its chance to be clean, and the iterations that theory asks for."""
    n_terms = (F.col("order") + 1) * (F.col("order") + 2) / 2
    g = _grid(spark).withColumn("k", half_up(F.col("k_mult") * n_terms).cast("long"))
    wk = F.pow(1.0 - F.col("eps"), F.col("k").cast("double"))
    n = F.ceil(F.log(F.lit(1 - 0.95)) / F.log(F.greatest(F.lit(2.2250738585072014e-308), 1.0 - wk))).cast("double")
    return g.select("order", "eps", "k_mult", "k", quantised(wk).alias("wk"), n.alias("n_theory"))


@query(f"WITH g AS (SELECT DISTINCT eps FROM ({_GRID})), n AS (SELECT CAST(eps AS DOUBLE) AS eps, CAST(floor(1000 * eps + 0.5) AS BIGINT) AS n_out FROM g) SELECT eps, n_out, 1000 - n_out AS n_in FROM n WHERE 1000 - n_out <= (SELECT count(*) FROM customer) AND n_out <= (SELECT count(*) FROM supplier)")
def capacity_guard(spark, sf):
    pools = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "supplier")]
    return tables.within_capacity(tables.with_counts(_grid(spark).select("eps").distinct(), 1000), *pools).select("eps", "n_out", "n_in")


@query(f"WITH p AS (SELECT DISTINCT p_size % 10 AS digit, CAST(p_size % 7 AS INTEGER) AS decade FROM part) SELECT CAST(digit AS INTEGER) AS digit, decade, CASE WHEN digit = 0 THEN 'OLS' ELSE regexp_replace(regexp_replace(printf('%.0e', CAST(digit AS DOUBLE) / pow(10.0, decade)), 'e\\+0*', 'e'), 'e-0*', 'm') END AS tag, printf('l%03d', CAST(floor(digit * 1000 / pow(10.0, decade) + 0.5) AS INTEGER)) AS code FROM p")
def tag_format(spark, sf):
    """Tags of strengths of one digit, made of a table's sizes."""
    p = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_size") % 10).cast("int").alias("digit"), (F.col("p_size") % 7).cast("int").alias("decade")).distinct()
    g = p.withColumn("strength", F.col("digit").cast("double") / F.pow(F.lit(10.0), F.col("decade")))
    code = F.format_string("l%03d", F.floor(F.col("digit") * 1000 / F.pow(F.lit(10.0), F.col("decade")) + 0.5))
    return g.select("digit", "decade", analysis.strength_tag(F.col("strength")).alias("tag"), code.alias("code"))


_LOG = "SELECT event_type AS config, event_id AS iter, value / 500.0 AS score FROM events"


def log_of(spark, sf) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("event_type").alias("config"), F.col("event_id").alias("iter"), (F.col("value") / 500.0).alias("score"))


@query(f"WITH log AS ({_LOG}), p AS ({hazen_sql('log', 'config', 'score', [50, 90, 95, 99.8, 100])}) SELECT config, " + ", ".join(f"{Q(f'p{n}')} AS p{n}" for n in ("50", "90", "95", "99_8", "100")) + " FROM p")
def pct_hazen(spark, sf):
    p = hazen(log_of(spark, sf), ["config"], "score", [50, 90, 95, 99.8, 100])
    return q(p, *[c for c in p.columns if c != "config"])


@query(f"SELECT config, {Q('median(score)')} AS median_score FROM ({_LOG}) GROUP BY config")
def median_value(spark, sf):
    return q(hazen(log_of(spark, sf), ["config"], "score", [50]).withColumnRenamed("p50", "median_score"), "median_score")


@query(f"WITH log AS ({_LOG}), p AS ({hazen_sql('log', '', 'score', [25, 75])}), e AS (SELECT count(*) AS n, min(score) AS low FROM log), w AS (SELECT low, 2 * (p75 - p25) * pow(CAST(n AS DOUBLE), {-1 / 3!r}) AS width FROM e, p) SELECT config, CAST(floor((score - low) / width) AS BIGINT) AS bin, count(*) AS n FROM log, w GROUP BY config, bin")
def hist_fd(spark, sf):
    return analysis.histogram_fd(log_of(spark, sf), ["config"], "score")


@query(f"WITH log AS ({_LOG}), s AS (SELECT config, min(score) AS low, max(score) AS high FROM log GROUP BY config), c AS (SELECT config, CAST(least(60, floor((score - low) / ((high - low) / 60)) + 1) AS INTEGER) AS bin, count(*) AS n FROM log JOIN s USING (config) GROUP BY config, bin), g AS (SELECT config, unnest(range(1, 61)) AS bin FROM s) SELECT g.config, CAST(g.bin AS INTEGER) AS bin, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.config = c.config AND g.bin = c.bin")
def hist60(spark, sf):
    return analysis.histogram_fixed(log_of(spark, sf), ["config"], "score")


@query(f"WITH log AS ({_LOG}), s AS (SELECT config, min(score) AS low, max(score) AS high FROM log GROUP BY config), c AS (SELECT config, least(60, floor((score - low) / ((high - low) / 60)) + 1) AS bin, count(*) AS n FROM log JOIN s USING (config) GROUP BY config, bin) SELECT max(n) AS peak, CAST(ceil(max(n) * CAST(1.05 AS DOUBLE)) AS BIGINT) AS axis_top FROM c")
def panel_max(spark, sf):
    h = analysis.histogram_fixed(log_of(spark, sf), ["config"], "score")
    return h.agg(F.max("n").alias("peak")).select("peak", F.ceil(F.col("peak") * F.lit(1.05)).alias("axis_top"))


ALPHAS = [0.10 + k * (1.02 - 0.10) / 119 for k in range(120)]
_ALPHA_LIST = "[" + ", ".join(f"{a:.17E}" for a in ALPHAS) + "]"


@query(f"WITH log AS ({_LOG}), t AS (SELECT unnest({_ALPHA_LIST}) AS alpha) SELECT config, {Q('alpha')} AS alpha, {Q('avg(CAST(score > alpha AS DOUBLE))')} AS p FROM log, t GROUP BY config, t.alpha")
def exceedance(spark, sf):
    return q(analysis.exceedance(log_of(spark, sf), ["config"], "score", ALPHAS), "alpha", "p")


_REF = [0.05, 0.1, 0.2, 0.9]
_RATES = f"log AS ({_LOG}), t AS (SELECT unnest([5E-2, 1E-1, 2E-1, 9E-1]) AS alpha), rates AS (SELECT config, alpha, avg(CAST(score > alpha AS DOUBLE)) AS p FROM log, t GROUP BY config, alpha)"


@query(f"WITH {_RATES} SELECT config, alpha, {Q('p')} AS p, CASE WHEN p <= 0 THEN NULL ELSE CAST(ceil(ln(1 - CAST(0.95 AS DOUBLE)) / ln(greatest(2.2250738585072014E-308, 1.0 - p))) AS DOUBLE) END AS n_implied FROM rates")
def implied_n(spark, sf):
    r = analysis.exceedance(log_of(spark, sf), ["config"], "score", _REF)
    return q(r.withColumn("n_implied", analysis.iterations_for(F.col("p"), 0.95)), "p").select("config", "alpha", "p", "n_implied")


_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"WITH {_RATES} SELECT alpha, " + ", ".join(f"{Q(f'max(p) FILTER (config = {chr(39)}{c}{chr(39)})')} AS {c}" for c in _TYPES) + " FROM rates GROUP BY alpha")
def exceedance_pivot(spark, sf):
    r = analysis.exceedance(log_of(spark, sf), ["config"], "score", _REF)
    return q(analysis.pivot_thresholds(r, "config", list(_TYPES)), *_TYPES)


@query(f"WITH {_RATES} SELECT config || ': ' || string_agg(printf('P(>%.2f)=%.4f', alpha, floor(p * 10000 + 0.5) / 10000), ' ' ORDER BY alpha) AS line FROM rates GROUP BY config")
def wide_report(spark, sf):
    """A summary line for each configuration."""
    r = analysis.exceedance(log_of(spark, sf), ["config"], "score", _REF)
    cell = F.format_string("P(>%.2f)=%.4f", F.col("alpha"), F.floor(F.col("p") * 10000 + 0.5) / 10000)
    rows = r.groupBy("config").agg(F.array_sort(F.collect_list(F.struct("alpha", cell.alias("cell")))).alias("c"))
    return rows.select(F.concat(F.col("config"), F.lit(": "), F.array_join(F.transform("c", lambda x: x["cell"]), " ")).alias("line"))


_OVER = "(PARTITION BY config ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND"


@query(f"WITH log AS ({_LOG}), b AS (SELECT *, greatest(0.13, coalesce(max(score) OVER {_OVER} 1 PRECEDING), 0.13)) AS best FROM log) SELECT config, iter, {Q('best')} AS best, score >= best AS gate FROM b")
def running_best(spark, sf):
    return q(analysis.running(log_of(spark, sf), ["config"], "iter", "score", 0.13), "best").select("config", "iter", "best", "gate")


@query(f"WITH log AS ({_LOG}), v AS (SELECT *, (iter % 10) / 10.0 AS v FROM log) SELECT config, iter, {Q(f'(4.6 * 0.33 + sum(score * v) OVER {_OVER} CURRENT ROW)) / (4.6 + sum(score) OVER {_OVER} CURRENT ROW))')} AS omega FROM v")
def omega_running(spark, sf):
    log = log_of(spark, sf).withColumn("v", F.col("iter") % 10 / 10.0)
    return q(analysis.running_weight(log, ["config"], "iter", "score", "v"), "omega").select("config", "iter", "omega")


@query(f"WITH log AS (SELECT config, iter, 0.5 + score / 2 AS w FROM ({_LOG})), n AS (SELECT *, CAST(2 * ceil(ln(1 - CAST(0.96 AS DOUBLE)) / ln(greatest(2.2250738585072014E-308, least(1 - 1E-12, 1.0 - pow(w, 6))))) AS DOUBLE) AS n FROM log) SELECT config, iter, least(CAST(2000 AS DOUBLE), min(n) OVER {_OVER} CURRENT ROW)) AS max_iter FROM n")
def running_limit(spark, sf):
    log = log_of(spark, sf).withColumn("w", 0.5 + F.col("score") / 2)
    return analysis.running_limit(log, ["config"], "iter", "w", 6, 0.96, 2000).select("config", "iter", "max_iter")


@query(f"WITH RECURSIVE log AS (SELECT config, score, row_number() OVER (PARTITION BY config ORDER BY iter) AS n, iter FROM ({_LOG})), e AS (SELECT config, n, iter, 0.8 * CAST(0.65 AS DOUBLE) + (1 - CAST(0.8 AS DOUBLE)) * score AS w FROM log WHERE n = 1 UNION ALL SELECT l.config, l.n, l.iter, 0.8 * e.w + (1 - CAST(0.8 AS DOUBLE)) * l.score FROM e JOIN log l ON l.config = e.config AND l.n = e.n + 1) SELECT config, iter, {Q('w')} AS w FROM e")
def ema_w(spark, sf):
    return q(analysis.moving_average(log_of(spark, sf), ["config"], "iter", "score", 0.65), "w").select("config", "iter", "w")


@query(f"WITH log AS (SELECT config, iter, CASE WHEN iter % 100 < 97 THEN score END AS score FROM ({_LOG})), l AS (SELECT config, max(iter) FILTER (score IS NOT NULL) AS last FROM log GROUP BY config) SELECT config, count(*) AS n, max(iter) AS last FROM log JOIN l USING (config) WHERE iter <= last GROUP BY config")
def last_valid(spark, sf):
    log = log_of(spark, sf).withColumn("score", F.when(F.col("iter") % 100 < 97, F.col("score")).otherwise(F.lit(float("nan"))))
    return analysis.last_valid(log, ["config"], "iter", "score").groupBy("config").agg(F.count("*").alias("n"), F.max("iter").alias("last"))


for _late, _dir in ((True, "DESC"), (False, "ASC")):
    query(
        f"WITH log AS (SELECT config, iter, floor(score * 50) / 50 AS score FROM ({_LOG})), r AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY score DESC, iter {_dir}) AS k FROM log WHERE score >= 0.13) SELECT config, iter, {Q('score')} AS score FROM r WHERE k = 1",
        "argmax_late" if _late else "argmax_early",
    )(lambda spark, sf, late=_late: q(analysis.best_row(log_of(spark, sf).withColumn("score", F.floor(F.col("score") * 50) / 50), ["config"], "iter", "score", 0.13, late), "score"))


@query(f"WITH log AS ({_LOG}), p AS ({hazen_sql('log', 'config', 'score', [99.8])}), t AS ({hazen_sql('log', 'config', 'score', [90])}) SELECT config, iter, {Q('score')} AS score, score >= p90 AS local_top FROM log JOIN p USING (config) JOIN t USING (config) WHERE score >= 0.6 * p99_8")
def top_pct_subset(spark, sf):
    log = log_of(spark, sf)
    top = analysis.above_percentile(log, ["config"], "score", 99.8, 0.6)
    both = top.join(F.broadcast(hazen(log, ["config"], "score", [90])), "config").withColumn("local_top", F.col("score") >= F.col("p90"))
    return q(both, "score").select("config", "iter", "score", "local_top")


@query(f"WITH log AS (SELECT config, iter, CASE WHEN iter % 9 = 0 THEN NULL ELSE score END AS score FROM ({_LOG})) SELECT config, count(*) FILTER (score IS NOT NULL) AS n_finite, count(*) FILTER (score IS NOT NULL AND score > 0) AS n_positive, count(*) FILTER (score IS NOT NULL AND (score > 0.1 OR NOT score > 0.02)) AS n_mask, bool_or(score > 0.7) AS any_high, count(*) FILTER (score = 0.2) AS n_equal FROM log GROUP BY config")
def log_filters(spark, sf):
    """Finite and positive masks, mask algebra, any-guards, equality filters."""
    log = log_of(spark, sf).withColumn("score", F.when(F.col("iter") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("score")))
    ok, v = finite(F.col("score")), F.col("score")
    return log.groupBy("config").agg(
        F.count_if(ok).alias("n_finite"), F.count_if(ok & (v > 0)).alias("n_positive"), F.count_if(ok & ((v > 0.1) | ~(v > 0.02))).alias("n_mask"),
        F.bool_or(ok & (v > 0.7)).alias("any_high"), F.count_if(ok & (v == 0.2)).alias("n_equal"),
    )


@query(f"WITH log AS ({_LOG}) SELECT config, {Q('least(min(score), min(score * 0.9 + 0.05))')} AS low, {Q('greatest(max(score), max(score * 0.9 + 0.05))')} AS high FROM log GROUP BY config")
def axis_limits(spark, sf):
    loc = F.col("score") * 0.9 + 0.05
    a = log_of(spark, sf).groupBy("config").agg(F.least(F.min("score"), F.min(loc)).alias("low"), F.greatest(F.max("score"), F.max(loc)).alias("high"))
    return q(a, "low", "high")


@query("SELECT DISTINCT CAST(s_nationkey AS INTEGER) AS nation, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier")
def distinct_grid(spark, sf):
    return spark.read.parquet(f"{sf}/supplier.parquet").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS k, CASE WHEN n_regionkey = n_nationkey % 5 THEN [CAST(n_regionkey AS INTEGER)] ELSE [CAST(n_regionkey AS INTEGER), CAST(n_nationkey % 5 AS INTEGER)] END AS stable FROM nation")
def stable_distinct(spark, sf):
    """Distinct values in the order of their first occurrence."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    a, b = F.col("n_regionkey").cast("int"), (F.col("n_nationkey") % 5).cast("int")
    return n.select(F.col("n_nationkey").alias("k"), F.array_distinct(F.array(a, b, a, b, a)).alias("stable"))


_RES = f"SELECT config, floor(iter / 1000) AS block, row_number() OVER (ORDER BY config, floor(iter / 1000)) AS row_id, CAST(6 AS INTEGER) AS \"order\", (floor(iter / 1000) % 5) / 10.0 + 1E-11 AS eps, 1.2 AS k_mult, (floor(iter / 1000) % 2) * 2E-3 + 1E-13 AS strength, max(score) AS best FROM ({_LOG}) GROUP BY config, floor(iter / 1000)"


def _results(spark, sf) -> DataFrame:
    b = F.floor(F.col("iter") / 1000)
    r = log_of(spark, sf).groupBy("config", b.alias("block")).agg(F.max("score").alias("best"))
    r = tables.numbered(r, ["config", "block"])
    strength = F.col("block") % 2 * 2e-3 + 1e-13
    return r.select("row_id", F.lit(6).alias("order"), (F.col("block") % 5 / 10.0 + 1e-11).alias("eps"), F.lit(1.2).alias("k_mult"), strength.alias("strength"), "best")


_WANT = "SELECT unnest([4, 6]) AS \"order\", eps, k_mult, strength FROM (SELECT unnest([0.0, 0.1, 0.2, 0.35]) AS eps), (SELECT unnest([1.2, 1.4]) AS k_mult), (SELECT unnest([0.0, 2E-3, 1E-2]) AS strength)"
_NEAR = {"eps": 1e-9, "k_mult": 1e-9, "strength": 1e-12}
_MATCH = "w.\"order\" = r.\"order\" AND abs(w.eps - r.eps) < 1E-9 AND abs(w.k_mult - r.k_mult) < 1E-9 AND abs(w.strength - r.strength) < 1E-12"


def _want(spark) -> DataFrame:
    return tables.grid(spark, order=[4, 6], eps=[0.0, 0.1, 0.2, 0.35], k_mult=[1.2, 1.4], strength=[0.0, 2e-3, 1e-2])


@query(f"WITH r AS ({_RES}), w AS ({_WANT}), m AS (SELECT w.*, r.row_id, r.best, row_number() OVER (PARTITION BY w.\"order\", w.eps, w.k_mult, w.strength ORDER BY row_id DESC) AS k FROM w JOIN r ON {_MATCH}) SELECT \"order\", CAST(eps AS DOUBLE) AS eps, CAST(k_mult AS DOUBLE) AS k_mult, CAST(strength AS DOUBLE) AS strength, CAST(row_id AS BIGINT) AS row_id, {Q('best')} AS best FROM m WHERE k = 1")
def lookup_tolerance(spark, sf):
    m = analysis.look_up(_want(spark), _results(spark, sf), ["order"], _NEAR, "row_id")
    return q(m.select("order", "eps", "k_mult", "strength", F.col("r_row_id").alias("row_id"), F.col("r_best").alias("best")), "best")


@query(f"WITH r AS ({_RES}), w AS ({_WANT}) SELECT \"order\", CAST(eps AS DOUBLE) AS eps, CAST(k_mult AS DOUBLE) AS k_mult, CAST(strength AS DOUBLE) AS strength FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_MATCH})")
def lookup_misses(spark, sf):
    return analysis.misses(_want(spark), _results(spark, sf), ["order"], _NEAR)


@query("WITH h AS (SELECT (min(o_orderkey) + max(o_orderkey)) // 2 AS half FROM orders) SELECT 1 AS pid, o_orderkey AS iter, CAST(floor(o_totalprice + 0.5) AS BIGINT) AS total, CASE WHEN o_orderkey < half THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS error, CASE WHEN o_orderkey < half THEN 'a' ELSE 'b' END AS batch FROM orders, h")
def log_append(spark, sf):
    """All orders in two batches with constant columns, parted half way between the least and the largest key, appended and put in order."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("iter"), F.floor(F.col("o_totalprice") + 0.5).alias("total"))
    half = o.agg(F.expr("(min(iter) + max(iter)) DIV 2")).first()[0] or 0
    log = None
    for part, error, name in ((o.filter(F.col("iter") < half), 0.2, "a"), (o.filter(F.col("iter") >= half), 0.1, "b")):
        log = tables.appended(log, tables.with_constants(part, error=error, pid=1, batch=name))
    return tables.ordered(log, ["pid", "iter", "total", "error", "batch"])


@query(f"WITH log AS ({_LOG}) SELECT config, iter // 500 AS run, list({Q('score')} ORDER BY iter) AS scores, list(iter ORDER BY iter) AS iters FROM log GROUP BY config, iter // 500")
def nested_res(spark, sf):
    """A row for each configuration and run, with its vectors; a run has a bounded number of iterations."""
    log = log_of(spark, sf).withColumn("scores", quantised(F.col("score"))).withColumn("iters", F.col("iter")).withColumn("run", F.floor(F.col("iter") / 500))
    return tables.nested(log, ["config", "run"], "iter", "scores", "iters")


@query(f"WITH {_RATES} SELECT config, {Q('max(p) FILTER (alpha = 1E-1)')} AS p_ref, true AS none_is_nan FROM rates GROUP BY config")
def pluck_exact(spark, sf):
    """The entry of a vector at an exact key; none gives NaN."""
    n = tables.nested(analysis.exceedance(log_of(spark, sf), ["config"], "score", _REF), ["config"], "alpha", "alpha", "p")
    return n.select("config", quantised(tables.value_at(F.col("p"), F.col("alpha"), 0.1)).alias("p_ref"), F.isnan(tables.value_at(F.col("p"), F.col("alpha"), 0.77)).alias("none_is_nan"))


# --- sampling and sources -------------------------------------------------

_U = lambda src, seed, it, draw: uniform_sql(src, seed, it, draw, "u")


@query(f"SELECT point_id FROM ({_U(f'({_RAW})', 7, '0', 'point_id')}) ORDER BY u, point_id LIMIT 50")
def sample_uniform(spark, sf):
    """50 distinct points: the smallest random numbers."""
    return clouds.from_embeddings(spark, sf).withColumn("u", uniform(7, 0, F.col("point_id"))).orderBy("u", "point_id").limit(50).select("point_id")


_DRAWS = _U("(SELECT unnest(range(0, 200)) AS draw)", 11, "1", "draw")


@query(f"WITH c AS (SELECT point_id, x, CAST(1 + label AS BIGINT) AS w FROM ({_RAW})), e AS (SELECT *, CAST(sum(w) OVER (ORDER BY point_id) AS BIGINT) AS hi FROM c), d AS (SELECT draw, CAST(floor(u * (SELECT max(hi) FROM e)) AS BIGINT) AS at FROM ({_DRAWS})) SELECT draw, point_id, {Q('x')} AS x FROM d JOIN e ON d.at >= e.hi - e.w AND d.at < e.hi")
def sample_weighted(spark, sf):
    """Draws with replacement in proportion to integer weights, by inverse distribution, and the gathered points.

    Cumulative weights come from per-block sums, so no task orders all points.
    """
    c = clouds.from_embeddings(spark, sf).select("point_id", "x", (F.lit(1) + F.col("label")).cast("long").alias("w")).withColumn("block", F.floor(F.col("point_id") / 65536))
    sums = c.groupBy("block").agg(F.sum("w").alias("bw"))
    before = sums.withColumn("b0", F.coalesce(F.sum("bw").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = c.join(before, "block").withColumn("hi", F.col("b0") + F.sum("w").over(Window.partitionBy("block").orderBy("point_id")))
    total = before.agg(F.sum("bw").alias("total"))
    d = spark.range(200).select(F.col("id").alias("draw"), uniform(11, 1, F.col("id")).alias("u")).join(F.broadcast(total)).select("draw", F.floor(F.col("u") * F.col("total")).alias("at"))
    placed = before.join(F.broadcast(d), (F.col("at") >= F.col("b0")) & (F.col("at") < F.col("b0") + F.col("bw"))).select("draw", "at", "block")
    got = placed.join(e, (placed["block"] == e["block"]) & (F.col("at") >= F.col("hi") - F.col("w")) & (F.col("at") < F.col("hi")))
    return q(got.select("draw", "point_id", "x"), "x")


@query(f"WITH d AS ({_U('(SELECT unnest(range(0, 64)) AS draw)', 5, '3', 'draw')}), g AS (SELECT draw, CAST(floor(u * (SELECT count(*) FROM embeddings)) AS BIGINT) AS point_id FROM d), p AS (SELECT g.draw, c.* FROM g JOIN ({_RAW}) c USING (point_id)) SELECT count(*) AS n, {Q('avg(x)')} AS cx, {Q('avg(y)')} AS cy, {Q('avg(z)')} AS cz FROM p")
def gather(spark, sf):
    """Equal-weight draws are floor(u N); duplicates count in the sample's centroid."""
    c = clouds.from_embeddings(spark, sf)
    d = spark.range(64).select(uniform(5, 3, F.col("id")).alias("u")).join(F.broadcast(c.agg(F.count("*").alias("total")))).select(F.floor(F.col("u") * F.col("total")).alias("point_id"))
    return q(c.join(F.broadcast(d), "point_id").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz")), "cx", "cy", "cz")


def _two(src: str, seed: int, draw: str) -> str:
    one = uniform_sql(src, seed, "0", draw, "u")
    return uniform_sql(f"({one})", seed, "1", draw, "v")


def _pick_sql(k: str, cases: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {k} = {i} THEN {c}" for i, c in enumerate(cases)) + " END"


_CUBE = f"SELECT point_id, {{x}} AS x, {{y}} AS y, {{z}} AS z FROM (SELECT point_id, u * 2 - 1 AS u, v * 2 - 1 AS v, point_id % 6 AS k FROM ({_two('(SELECT unnest(range(0, 1200)) AS point_id)', 1, 'point_id')}))"


@query(_CUBE.format(x=Q(_pick_sql("k", ["u", "u", "1.0", "-1.0", "u", "u"])), y=Q(_pick_sql("k", ["v", "v", "u", "u", "1.0", "-1.0"])), z=Q(_pick_sql("k", ["1.0", "-1.0", "v", "v", "v", "v"]))))
def gen_cube(spark, sf):
    return q(generators.cube(spark, 1200), "x", "y", "z")


@query(f"WITH c AS (SELECT c, u * 2 - 1 AS u, v * 2 - 1 AS v, c % 6 AS k FROM ({_two('(SELECT unnest(range(0, 2464)) AS c)', 1, 'c')})), s AS (SELECT *, sqrt(greatest(0.0, 1 - u*u)) AS a FROM c WHERE k > 1 OR u*u + v*v <= 1), p AS (SELECT row_number() OVER (ORDER BY c) - 1 AS point_id, {_pick_sql('k', ['u', 'u', 'a', '-a', 'u', 'u'])} AS x, {_pick_sql('k', ['v', 'v', 'u', 'u', 'a', '-a'])} AS y, {_pick_sql('k', ['1.0', '-1.0', 'v', 'v', 'v', 'v'])} AS z FROM s) SELECT point_id, {Q('x')} AS x, {Q('y')} AS y, {Q('z')} AS z FROM p WHERE point_id < 1200")
def gen_cylinder(spark, sf):
    return q(generators.cylinder(spark, 1200), "x", "y", "z")


_H = f"{generators.SQRT3 / 2:.17E}"
_RHOMBI = [(f"(u * {a} + v * {c})", f"(u * {b} + v * {d})") for (a, b), (c, d) in ((("1.0", "0.0"), ("-0.5", _H)), (("-0.5", _H), ("-0.5", f"-{_H}")), (("-0.5", f"-{_H}"), ("1.0", "0.0")))]
_WALLS = [(f"(u * {a} + (1 - u) * {c})", f"(u * {b} + (1 - u) * {d})") for (a, b), (c, d) in ((("1.0", "0.0"), ("0.5", _H)), (("0.5", _H), ("-0.5", _H)), (("-0.5", _H), ("-1.0", "0.0")))]
_HEX = f"SELECT point_id, {{x}} AS x, {{y}} AS y, {{z}} AS z FROM (SELECT *, point_id % 12 AS k FROM ({_two('(SELECT point_id, point_id // 2 AS pair FROM (SELECT unnest(range(0, 1200)) AS point_id))', 1, 'pair')}))"
_HX, _HY = ([p[i] for p in _RHOMBI for _ in "ab"] + [f"{p[i]} * {sign}" for p in _WALLS for sign in ("1.0", "-1.0")] for i in (0, 1))


@query(_HEX.format(x=Q(_pick_sql("k", _HX)), y=Q(_pick_sql("k", _HY)), z=Q(_pick_sql("k", ["1.0", "-1.0"] * 3 + ["v * 2 - 1"] * 6))))
def gen_hexagon_prism(spark, sf):
    return q(generators.hexagon_prism(spark, 1200), "x", "y", "z")


_GAUSS = lambda a, b: f"sqrt(-2.0 * ln({a})) * cos({b} * 6.283185307179586)"


def _sphere_sql(n: int, seed: int) -> str:
    src = f"(SELECT unnest(range(0, {n})) AS point_id)"
    for i in range(3):
        for k in range(2):
            src = f"({uniform_sql(src, seed + 2 * i + k, str(i), 'point_id', f'u{i}{k}')})"
    g = f"SELECT point_id, {', '.join(f'{_GAUSS(f"u{i}0", f"u{i}1")} AS {a}' for i, a in enumerate('xyz'))} FROM {src}"
    return f"SELECT point_id, x / sqrt(x*x+y*y+z*z) AS x, y / sqrt(x*x+y*y+z*z) AS y, z / sqrt(x*x+y*y+z*z) AS z FROM ({g})"


@query(f"SELECT point_id, {Q('x')} AS x, {Q('y')} AS y, {Q('z')} AS z FROM ({_sphere_sql(1000, 1)})")
def gen_sphere(spark, sf):
    return q(generators.sphere(spark, 1000), "x", "y", "z")


def _ellipsoid_sql(n: int, axes: tuple[float, float, float], candidates: int = 20_000) -> str:
    """Accepted candidates in their order: any number of them that gives n points gives the same."""
    d, s4 = (" + ".join(f"{a}*{a} / {v**p!r}" for a, v in zip("xyz", axes)) for p in (2, 4))
    w = f"({d}) * ({d}) / sqrt({s4})"
    drawn = uniform_sql(f"({_sphere_sql(candidates, 1)})", 51, "9", "point_id", "r")
    return f"WITH top AS (SELECT max({w}) * 1.1 AS most FROM ({_sphere_sql(20_000, 101)})), c AS (SELECT *, {d} AS d, {w} AS w FROM ({drawn})), k AS (SELECT row_number() OVER (ORDER BY point_id) - 1 AS point_id, {', '.join(f'{a} / sqrt(d) AS {a}' for a in 'xyz')} FROM c, top WHERE r < w / most) SELECT point_id, {', '.join(f'{Q(a)} AS {a}' for a in 'xyz')} FROM k WHERE point_id < {n}"


@query(_ellipsoid_sql(800, (1.0, 1.0, 3.0)))
def gen_ellipsoid(spark, sf):
    return q(generators.ellipsoid(spark, 800, 1.0, 1.0, 3.0), "x", "y", "z")


def _uniform3(n: int, seed: int) -> str:
    src = f"(SELECT unnest(range(0, {n})) AS point_id)"
    for i in range(3):
        src = f"({uniform_sql(src, seed, str(i), 'point_id', f'u{i}')})"
    return src


@query(f"SELECT point_id, {', '.join(f'{Q(f"(u{i} * 2 - 1) * 1.7")} AS {a}' for i, a in enumerate('xyz'))} FROM {_uniform3(900, 3)}")
def gen_outliers(spark, sf):
    return q(generators.outliers(spark, 900, 1.7, 3), "x", "y", "z")


def _jitter_sql() -> str:
    src = f"({_sphere_sql(500, 1)})"
    for i in range(3):
        for k in range(2):
            src = f"({uniform_sql(src, 21 + 2 * i + k, str(i), 'point_id', f'u{i}{k}')})"
    return f"SELECT point_id, {', '.join(f'{Q(f"{a} + {_GAUSS(f"u{i}0", f"u{i}1")} * 0.007")} AS {a}' for i, a in enumerate('xyz'))} FROM {src}"


@query(_jitter_sql())
def gen_jitter(spark, sf):
    return q(generators.jittered(generators.sphere(spark, 500), 0.007, 21), "x", "y", "z")


# --- consensus ------------------------------------------------------------


def _labelled(spark, sf: str) -> DataFrame:
    """The cloud of the vectors; labels from 5 on count as inliers."""
    return cloud_of(spark, sf).withColumn("gt", F.col("label") >= 5)


_FROZEN = [ransac.Config(config_id=i, order=o, k_mult=1.4, strength=v, max_iter=60, conf=0.95, thresh=THRESH, freeze_w=True, freeze_iter=True, freeze_omega=True) for i, (o, v) in enumerate(((2, 2e-3), (4, 2e-3), (6, 2e-3), (6, 1e-2)))]
_ADAPTIVE = [ransac.Config(config_id=i, order=4, k_mult=k, strength=2e-3, max_iter=12, thresh=0.55, update_thresh=0.6, freeze_iter=f) for i, (k, f) in enumerate(((1.0, True), (1.2, True), (1.2, False)))]


def _log_view(log: DataFrame) -> DataFrame:
    own = ["pre_score", "post_score", "inlier_ratio", "mse_all", "mse_inlier", "w", "max_n", "max_iter", "tp", "fp", "fn", "tn", "precision", "recall", "f1"]
    return q(log.select("config_id", "iter_no", "singular", *own), *own, digits=5)


@query()
def ransac_frozen(spark, sf):
    return _log_view(ransac.run(_labelled(spark, sf), _FROZEN))


@query()
def ransac_adaptive(spark, sf):
    return _log_view(ransac.run(_labelled(spark, sf), _ADAPTIVE))


@query()
def ransac_best(spark, sf):
    """The best model of each configuration."""
    b = ransac.best_models(ransac.run(_labelled(spark, sf), _FROZEN))
    return q(b.select("config_id", "iter_no", "post_score", "inlier_ratio", "recall", "precision"), "post_score", "inlier_ratio", "recall", "precision", digits=5)


@query()
def solver_embeddings(spark, sf):
    """The whole solver on a table's cloud: displacement and inliers of the best model."""
    b = ransac.solve_cloud(cloud_of(spark, sf), ransac.Config(order=2, k_mult=2.0, max_iter=30, thresh=THRESH), RIDGE)
    return q(b.select("config_id", F.col("disp")[0].alias("dx"), F.col("disp")[1].alias("dy"), F.col("disp")[2].alias("dz"), "inlier_ratio", "post_score"), "dx", "dy", "dz", "inlier_ratio", "post_score", digits=5)


_STEPPED = ransac.Config(order=2, k_mult=2.0, strength=RIDGE, max_iter=2, thresh=THRESH, loc_iters=2)


def _solver_sql(c: ransac.Config) -> str:
    """Every step of the solver's first iterations written out: draws by weight, fit, gate (it is open), refinement, scores, new weights."""
    out = CLOUD + ", w0 AS (SELECT point_id, x, y, z, CAST(0.33 AS DOUBLE) AS omega, CAST(4.6 AS DOUBLE) AS mass FROM cloud)"
    ends = []
    for i in range(1, c.max_iter + 1):
        draw = uniform_sql(f"(SELECT unnest(range(0, {c.sample_size})) AS draw)", c.seed, str(i), "draw", "u")
        out += f", o{i} AS MATERIALIZED (SELECT *, sum(omega) OVER (ORDER BY point_id) AS upto, sum(omega) OVER () AS whole FROM w{i - 1}), d{i} AS ({draw})"
        out += f", k{i} AS MATERIALIZED (SELECT draw, min(upto) AS upto FROM d{i} JOIN o{i} ON upto > u * whole GROUP BY draw), s{i} AS MATERIALIZED (SELECT x, y, z FROM k{i} JOIN o{i} USING (upto))"
        out += f", mid{i} AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM s{i}), own{i} AS (SELECT x - mx AS x, y - my AS y, z - mz AS z FROM s{i}, mid{i})" + _named_fit(f"raw{i}", f"own{i}", c.strength, penalty(c.basis, c.order))
        out += f", r{i} AS MATERIALIZED (SELECT x, y, z, abs({_F} - 1.0) AS r FROM (SELECT x - mx AS x, y - my AS y, z - mz AS z FROM cloud, mid{i}), beta_raw{i}), pre{i} AS (SELECT avg(exp(-(r * r) / {2 * c.sigma**2!r})) AS pre_score FROM r{i}), in{i} AS (SELECT x, y, z FROM r{i} WHERE r < {c.thresh})"
        out += _refine_ctes(f"l{i}", f"in{i}", c.loc_iters, c.momentum, c.damping, c.strength, penalty(c.basis, c.order))
        out += f", at{i} AS (SELECT dx + mx AS dx, dy + my AS dy, dz + mz AS dz FROM disp_l{i}, mid{i}), f{i} AS MATERIALIZED (SELECT point_id, abs({_F} - 1.0) AS r FROM (SELECT point_id, x - dx AS x, y - dy AS y, z - dz AS z FROM cloud, at{i}), beta_l{i}{c.loc_iters})"
        out += f", post{i} AS MATERIALIZED (SELECT avg(exp(-(r * r) / {2 * c.sigma**2!r})) AS post_score, avg(CASE WHEN r < {c.thresh} THEN 1.0 ELSE 0.0 END) AS inlier_ratio, avg(r * r) AS mse_all FROM f{i})"
        out += f", w{i} AS MATERIALIZED (SELECT point_id, x, y, z, (mass * omega + post_score * exp(-(r * r) / {2 * c.sigma**2!r})) / (mass + post_score) AS omega, mass + post_score AS mass FROM w{i - 1} JOIN f{i} USING (point_id), post{i})"
        columns = [f"{Q(n, 5)} AS {n}" for n in ("pre_score", "post_score", "inlier_ratio", "mse_all", "dx", "dy", "dz")]
        ends.append(f"SELECT {i} AS iter_no, {', '.join(columns)}, {Q(_NORM, 4)} AS beta_norm FROM pre{i}, post{i}, at{i}, beta_l{i}{c.loc_iters}")
    return out + " " + " UNION ALL ".join(ends)


@query(_solver_sql(_STEPPED))
def solver_steps(spark, sf):
    """The solver's first two iterations; the second one's draws follow the weights that the first one leaves."""
    names = ["dx", "dy", "dz"]
    log = ransac.run(cloud_of(spark, sf), [_STEPPED]).select("iter_no", "pre_score", "post_score", "inlier_ratio", "mse_all", *[F.col("disp")[k].alias(n) for k, n in enumerate(names)], "beta_norm")
    return q(q(log, "pre_score", "post_score", "inlier_ratio", "mse_all", *names, digits=5), "beta_norm", digits=4)


@query()
def experiment_table(spark, sf):
    """Nested experiment rows with analysis vectors: log, vectors by configuration, exceedance of the recalls."""
    log = ransac.run(_labelled(spark, sf), _ADAPTIVE[:2])
    n = tables.nested(q(log, "post_score", "recall", digits=5), ["config_id"], "iter_no", "post_score", "recall")
    r = tables.nested(analysis.exceedance(log, ["config_id"], "recall", [0.2, 0.5, 0.8]), ["config_id"], "alpha", "alpha", "p")
    return n.join(F.broadcast(r), "config_id", "left").select("config_id", "post_score", "recall", "alpha", "p")


#: The order of the published table's columns; timings stand among them, but never reproduce.
_RESULT_NAMES = [
    "pid", "Qid", "sigma", "error", "q", "iter", "N", "pre_score", "post_score", "raw_ms", "loc_ms", "w", "max_n", "inlier_ratio", "beta_norm", "sdf_rms", "sdf_p50", "disp",
    "tp", "fp", "fn", "tn", "precision", "recall", "f1", "mse_all", "mse_inlier",
]


@query()
def result_table(spark, sf):
    """The log with its constant columns in the order of the published table, less the timings; distances that were never stored stay null."""
    c = _ADAPTIVE[0]
    cloud = _labelled(spark, sf)
    log = tables.with_constants(ransac.run(cloud, [c]), pid=1, Qid=1, sigma=0.01, error=0.2, q=0.0, iter=c.loc_iters, N=cloud.count())
    log = log.withColumns({"sdf_rms": F.lit(None).cast("double"), "sdf_p50": F.when(~F.isnan("post_score"), F.lit(float("nan"))), "disp": F.transform("disp", lambda v: quantised(v, 5))})
    out = tables.ordered(log, _RESULT_NAMES).drop("raw_ms", "loc_ms")
    return q(out, "pre_score", "post_score", "inlier_ratio", "beta_norm", "mse_all", "mse_inlier", "w", "precision", "recall", "f1", digits=5)


@query(f"SELECT config, 'MC_' || config AS name, count(*) AS n FROM ({_LOG}) WHERE config IN ('click', 'view') GROUP BY config")
def tag_lookup(spark, sf):
    """Results found by a computed name: names without a result drop out."""
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("MC_click", "MC_view", "MC_none")])).alias("name"))
    results = log_of(spark, sf).groupBy("config").agg(F.count("*").alias("n")).withColumn("tag", F.concat(F.lit("MC_"), F.col("config")))
    return results.join(F.broadcast(wanted), F.col("tag") == F.col("name")).select(F.replace(F.col("name"), F.lit("MC_"), F.lit("")).alias("config"), "name", "n")


@query("SELECT event_type, count(*) AS n, max(value) AS best_score FROM events GROUP BY event_type")
def stream_best(spark, sf):
    """The log as a stream, read to its end: iterations and best score by configuration."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    path = work_path(spark, "stream")
    name = path.rpartition("/")[2].replace("-", "_")
    stream = log_stream.best_so_far(log_stream.read_events(spark, sf, schema, names="events.parquet"))
    return log_stream.run_to_table(stream, name, "complete", path)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloud, basis, Gram sums, solve, residuals, scores: the whole fit in one query."""
    return residual_score(spark, sf_dir)
