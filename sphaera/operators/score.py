"""Residuals, soft weights, masks and their statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basis import Term
from .linalg import gradient, surface

SIGMA = 0.15


def with_residual(cloud: DataFrame, terms: tuple[Term, ...], beta: np.ndarray, threshold: float, sigma: float = SIGMA) -> DataFrame:
    """f, r = |f - 1|, soft = exp(-r**2 / 2 sigma**2), inlier = r < threshold (strict)."""
    out = cloud.withColumn("f", F.expr(surface(terms, beta))).withColumn("r", F.abs(F.col("f") - 1.0))
    return out.withColumn("soft", F.exp(-(F.col("r") * F.col("r")) / (2 * sigma * sigma))).withColumn("inlier", F.col("r") < threshold)


def with_distance(cloud: DataFrame, terms: tuple[Term, ...], beta: np.ndarray) -> DataFrame:
    """sdf: first-order signed distance (f - 1) / sqrt(max(1e-12, |grad f|**2))."""
    gx, gy, gz = map(F.expr, gradient(terms, beta))
    f = F.expr(surface(terms, beta))
    return cloud.withColumn("sdf", (f - 1.0) / F.sqrt(F.greatest(F.lit(1e-12), gx * gx + gy * gy + gz * gz)))


def statistics(scored: DataFrame, omega: Column | None = None) -> DataFrame:
    """One row: rows, inliers, their share, soft score, mean squares, and the weight of inliers."""
    w = F.lit(1.0) if omega is None else omega
    r2 = F.col("r") * F.col("r")
    return scored.agg(
        F.count("*").alias("n_points"), F.count_if("inlier").alias("n_inliers"), F.avg(F.col("inlier").cast("double")).alias("inlier_ratio"),
        F.avg("soft").alias("soft_score"), F.avg(r2).alias("mse_all"), F.avg(F.when(F.col("inlier"), r2)).alias("mse_inlier"),
        (F.sum(F.when(F.col("inlier"), w).otherwise(0.0)) / F.sum(w)).alias("inlier_mass"),
    )


def confusion(rows: DataFrame, truth: Column, found: Column, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1; empty denominators give 0."""
    counts = rows.groupBy(*(keys or [])).agg(
        F.count_if(truth & found).alias("tp"), F.count_if(~truth & found).alias("fp"), F.count_if(truth & ~found).alias("fn"), F.count_if(~truth & ~found).alias("tn"),
    )
    tp = F.col("tp").cast("double")
    p, r = tp / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), tp / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    out = counts.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-12), F.col("precision") + F.col("recall")))


def score_models(cloud: DataFrame, terms: tuple[Term, ...], models: list[tuple[int, np.ndarray, np.ndarray]], threshold: float, sigma: float = SIGMA) -> DataFrame:
    """model_id, n_points, soft_score, inlier_ratio, mse_all of many models (id, displacement, coefficients) over one cloud.

    Models are few and go to the tasks; every block of points meets all of them in
    matrix products, and only sums per model leave a task, whatever the cloud's size.
    """
    from ..functions.basis import compiled

    def run(batches):
        basis, sums = compiled(terms), np.zeros((len(models), 4))
        for b in batches:
            points = b[["x", "y", "z"]].to_numpy(float)
            for k, (_, disp, beta) in enumerate(models):
                r = np.abs(basis.value(points - disp, beta) - 1)
                sums[k] += len(r), np.exp(-(r**2) / (2 * sigma**2)).sum(), (r < threshold).sum(), (r**2).sum()
        yield pd.DataFrame({"model_id": [m[0] for m in models], "n": sums[:, 0].astype(int), "s": sums[:, 1], "i": sums[:, 2], "q": sums[:, 3]})

    parts = cloud.select("x", "y", "z").mapInPandas(run, "model_id int, n bigint, s double, i double, q double")
    total = parts.groupBy("model_id").agg(*[F.sum(c).alias(c) for c in "nsiq"])
    n = F.nullif(F.col("n"), F.lit(0))
    return total.select("model_id", F.col("n").alias("n_points"), (F.col("s") / n).alias("soft_score"), (F.col("i") / n).alias("inlier_ratio"), (F.col("q") / n).alias("mse_all"))


def squared_norm(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v * v)


def lattice(spark, terms: tuple[Term, ...], beta: np.ndarray, extent: float, density: int) -> DataFrame:
    """Cells (i, j, k) of a cube lattice in which f - 1 changes sign: the samples of an implicit surface."""
    step = 2 * extent / density

    def cells(batches):
        for b in batches:
            n = b["id"].to_numpy()
            at = np.stack((n % density, n // density % density, n // density**2), 1)
            low, high = np.full(len(n), np.inf), np.full(len(n), -np.inf)
            for corner in np.ndindex(2, 2, 2):
                points = (at + corner) * step - extent
                f = sum(v * t.values(points) for v, t in zip(beta, terms)) - 1
                low, high = np.minimum(low, f), np.maximum(high, f)
            own = at[(low <= 0) & (high >= 0)]
            yield pd.DataFrame({"i": own[:, 0], "j": own[:, 1], "k": own[:, 2]})

    return spark.range(density**3).mapInPandas(cells, "i bigint, j bigint, k bigint")
