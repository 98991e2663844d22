"""Gram sums, ridge solves, centre shifts.

Sums run over the rows in one pass, partial sums first; what reaches the driver
is a matrix whose size the basis fixes (28 x 28 at order 6).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basis import Term, gradient_sql, penalty

#: Up to so many terms the Gram sums are generated columns; more go through NumPy blocks.
MAX_COLUMN_TERMS = 10


def with_design(cloud: DataFrame, terms: tuple[Term, ...], name: str = "phi") -> DataFrame:
    """The cloud with an array of all terms' values."""
    return cloud.withColumn(name, F.array(*[F.expr(t.sql()) for t in terms]))


def gram(cloud: DataFrame, terms: tuple[Term, ...]) -> DataFrame:
    """i, j (i <= j), value: sums of products of terms; j = -1: sums of terms; i = j = -1: rows."""
    n = len(terms)
    if n <= MAX_COLUMN_TERMS:
        p = cloud.select(*[F.expr(t.sql()).alias(f"p{k}") for k, t in enumerate(terms)])
        pairs = [(i, j) for i in range(n) for j in range(i, n)]
        sums = [F.sum(F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i, j in pairs] + [F.sum(f"p{i}").alias(f"m{i}") for i in range(n)]
        one = p.agg(*sums, F.count("*").cast("double").alias("rows"))
        cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g{i}_{j}").alias("value")) for i, j in pairs]
        cells += [F.struct(F.lit(i).alias("i"), F.lit(-1).alias("j"), F.col(f"m{i}").alias("value")) for i in range(n)]
        cells.append(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.col("rows").alias("value")))
        return one.select(F.inline(F.array(*cells)))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sphaera.functions.basis import design

        total, moment, rows = np.zeros((n, n)), np.zeros(n), 0
        for b in batches:
            phi = design(terms, b[["x", "y", "z"]].to_numpy(float))
            total, moment, rows = total + phi.T @ phi, moment + phi.sum(0), rows + len(b)
        i, j = np.triu_indices(n)
        yield pd.DataFrame({"i": np.concatenate((i, np.arange(n), [-1])), "j": np.concatenate((j, np.full(n + 1, -1))), "value": np.concatenate((total[i, j], moment, [rows]))})

    return cloud.select("x", "y", "z").mapInPandas(blocks, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


@dataclass(frozen=True)
class Gram:
    """The matrix, the moments and the number of rows, on the driver."""

    matrix: np.ndarray
    moment: np.ndarray
    rows: float

    @classmethod
    def collect(cls, cells: DataFrame, n: int) -> Gram:
        g, m, rows = np.zeros((n, n)), np.zeros(n), 0.0
        for i, j, v in cells.select("i", "j", "value").collect():
            v = v or 0.0
            if i < 0:
                rows = v
            elif j < 0:
                m[i] = v
            else:
                g[i, j] = g[j, i] = v
        return cls(g, m, rows)

    def spectrum(self) -> np.ndarray:
        """Eigenvalues of the matrix over the rows, largest first."""
        return np.sort(np.linalg.eigvalsh(self.matrix / max(self.rows, 1.0)))[::-1]


def solve(matrix: np.ndarray, moment: np.ndarray, rows: float, strength: float = 0.0, weights: np.ndarray | None = None) -> np.ndarray | None:
    """Coefficients of (G + strength rows diag(weights)) beta = m, weights one if none; None if the matrix is singular and unpenalised."""
    n = len(moment)
    if not rows:
        return None
    if strength:
        matrix = matrix + strength * rows * np.diag(np.ones(n) if weights is None else weights)
    elif np.linalg.matrix_rank(matrix, hermitian=True) < n:
        return None
    return np.linalg.solve(matrix, moment)


#: Triangles that are merged at once.
MERGED = 32


def triangle(cloud: DataFrame, terms: tuple[Term, ...]) -> tuple[np.ndarray, float]:
    """R of the QR factorisation of [design, ones] and the number of rows, without a product of the design with itself.

    Each task keeps one triangle while it reads its rows; the tasks' triangles are merged by
    ``MERGED`` in a tree until so few are left, and only those come to the driver. Condition numbers are not
    squared, as they are by Gram sums.
    """
    n = len(terms) + 1

    def stacked(held: np.ndarray, more: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.concatenate((held, more)), mode="r")

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sphaera.functions.basis import design

        held, rows = np.zeros((0, n)), 0
        for b in batches:
            for at in range(0, len(b), 4096):
                points = b[["x", "y", "z"]].to_numpy(float)[at : at + 4096]
                held, rows = stacked(held, np.column_stack((design(terms, points), np.ones(len(points))))), rows + len(points)
        if rows:
            yield pd.DataFrame({"part": b["part"].iloc[:1], "r": [held.tobytes()], "rows": [float(rows)]})

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros((0, n))
        for r in group["r"]:
            held = stacked(held, np.frombuffer(r).reshape(-1, n))
        return pd.DataFrame({"part": group["part"].iloc[:1] // MERGED, "r": [held.tobytes()], "rows": [group["rows"].sum()]})

    schema = "part bigint, r binary, rows double"
    parts = cloud.rdd.getNumPartitions()
    found = cloud.select("x", "y", "z", F.spark_partition_id().cast("long").alias("part")).mapInPandas(own, schema)
    while parts > MERGED:
        found = found.groupBy(F.floor(F.col("part") / MERGED)).applyInPandas(merged, schema)
        parts = -(-parts // MERGED)
    held, rows = np.zeros((0, n)), 0.0
    for r, k in sorted((bytes(r), k) for r, k in found.select("r", "rows").collect()):
        held, rows = stacked(held, np.frombuffer(r).reshape(-1, n)), rows + k
    return np.concatenate((held, np.zeros((max(0, n - len(held)), n)))), rows


def solve_triangle(r: np.ndarray, rows: float, strength: float = 0.0, weights: np.ndarray | None = None) -> np.ndarray | None:
    """Coefficients from the triangle of [design, ones]; the penalty is more rows of the design. None if the columns depend on each other and none is penalised."""
    n = r.shape[1] - 1
    if strength:
        penalty_rows = np.column_stack((np.diag(np.sqrt(strength * rows * (np.ones(n) if weights is None else weights))), np.zeros(n)))
        r = np.linalg.qr(np.concatenate((r, penalty_rows)), mode="r")
    upper, right = r[:n, :n], r[:n, n]
    # columns of very different size are no dependence
    size = np.linalg.norm(upper, axis=0)
    if not size.all() or np.linalg.cond(upper / size) > 1 / (8 * n * np.finfo(float).eps):
        return None
    return np.linalg.solve(upper / size, right) / size


def fit_qr(cloud: DataFrame, terms: tuple[Term, ...], strength: float = 0.0, order: int | None = None, s: float = 1.0) -> np.ndarray | None:
    """As fit, by QR: for clouds whose Gram matrix is singular to working precision."""
    r, rows = triangle(cloud, terms)
    return solve_triangle(r, rows, strength, None if order is None else penalty(terms, order, s))


def spectrum_qr(cloud: DataFrame, terms: tuple[Term, ...]) -> np.ndarray:
    """Eigenvalues of the Gram matrix over the rows, largest first: squares of the triangle's singular values, so small ones keep their digits."""
    r, rows = triangle(cloud, terms)
    return np.linalg.svd(r[:, :-1], compute_uv=False)[: len(terms)] ** 2 / max(rows, 1.0)


def fit(cloud: DataFrame, terms: tuple[Term, ...], strength: float = 0.0, order: int | None = None, s: float = 1.0) -> np.ndarray | None:
    """Implicit surface through the cloud; with order, the penalty follows the Sobolev weights."""
    g = Gram.collect(gram(cloud, terms), len(terms))
    return solve(g.matrix, g.moment, g.rows, strength, None if order is None else penalty(terms, order, s))


def surface(terms: tuple[Term, ...], beta: np.ndarray) -> str:
    """Expression of f = sum beta phi."""
    return "(" + " + ".join(f"{b:.17E}*{t.sql()}" for b, t in zip(beta, terms)) + ")"


def gradient(terms: tuple[Term, ...], beta: np.ndarray) -> tuple[str, str, str]:
    """Expressions of the partial derivatives of f."""
    return tuple("(" + " + ".join(f"{b:.17E}*{e}" for b, e in zip(beta, axis)) + ")" for axis in gradient_sql(terms))


def adjugate_solve(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Solution of the symmetric 3 x 3 system a d = b in closed form; null where it is singular."""
    xx, xy, xz, yy, yz, zz = (a[k] for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
    cxx, cxy, cxz = yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy
    cyy, cyz, czz = xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy
    det = F.nullif(xx * cxx + xy * cxy + xz * cxz, F.lit(0.0))
    x, y, z = b["x"], b["y"], b["z"]
    return (cxx * x + cxy * y + cxz * z) / det, (cxy * x + cyy * y + cyz * z) / det, (cxz * x + cyz * y + czz * z) / det


def shift_step(cloud: DataFrame, terms: tuple[Term, ...], beta: np.ndarray) -> DataFrame:
    """One row dx, dy, dz: (G'G)^-1 G'e with G the gradients and e = 1 - f, from nine sums."""
    names = ("gx", "gy", "gz")
    g = cloud.select(*[F.expr(e).alias(n) for e, n in zip(gradient(terms, beta), names)], (F.lit(1.0) - F.expr(surface(terms, beta))).alias("e"))
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = g.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias("xyz"[i] + "xyz"[j]) for i, j in pairs], *[F.sum(F.col(n) * F.col("e")).alias("b" + n[1]) for n in names])
    d = adjugate_solve({"xyz"[i] + "xyz"[j]: F.col("xyz"[i] + "xyz"[j]) for i, j in pairs}, {a: F.col("b" + a) for a in "xyz"})
    return sums.select(*[c.alias(f"d{a}") for c, a in zip(d, "xyz")])


def shrinkage(spectrum: np.ndarray, strengths: list[float]) -> list[tuple[float, float, float, float]]:
    """strength and ev / (ev + strength) of the least, median and largest eigenvalue."""
    picks = [float(np.min(spectrum)), float(np.median(spectrum)), float(np.max(spectrum))]
    return [(float(v), *[e / (e + v) if e + v else 0.0 for e in picks]) for v in strengths]
