"""Moment tensors of clouds: sums of x**a y**b z**c up to a degree, taken in one pass.

The moments to degree 2 d determine every Gram matrix of a basis of degree d, every sum of
its gradients and every sum of squared residuals. Moved points need no second pass: the
moments about another centre follow by binomials. So a fit with any number of refinement
steps takes some hundred numbers to the driver, whatever the size of the cloud.

Sums about a far centre cancel; take them about a centre near the points' own (all uses here
do). Then the fits of orders 2 to 6 agree with those from the points to some 1e-9 of their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basis import Term, compiled
from .linalg import solve

#: Up to this degree the sums are generated columns (35 of them); more go through NumPy blocks.
MAX_COLUMN_DEGREE = 4
#: Points whose powers are held at once.
CHUNK = 1 << 13


@lru_cache
def exponents(degree: int) -> tuple[tuple[int, int, int], ...]:
    return tuple((a, b, c) for a in range(degree + 1) for b in range(degree + 1 - a) for c in range(degree + 1 - a - b))


def degree_of(terms: tuple[Term, ...]) -> int:
    return max((sum(e) for t in terms for e, _ in t.coefficients), default=0)


def moment_sums(points: np.ndarray, degree: int) -> np.ndarray:
    """The sums of all exponents(degree) over points (n, 3)."""
    pairs = [(a, b) for a in range(degree + 1) for b in range(degree + 1 - a)]
    place = {p: i for i, p in enumerate(pairs)}
    total = np.zeros((len(pairs), degree + 1))
    for at in range(0, len(points), CHUNK):
        x, y, z = (np.power.outer(v, np.arange(degree + 1)) for v in points[at : at + CHUNK].T)
        both = np.stack([x[:, a] * y[:, b] for a, b in pairs], 1)
        total += both.T @ z
    return np.array([total[place[a, b], c] for a, b, c in exponents(degree)])


class Moments:
    """Moments about the origin, to a degree."""

    def __init__(self, degree: int, sums: np.ndarray):
        self.degree = degree
        self.dense = np.zeros((degree + 1,) * 3)
        self.dense[tuple(np.array(exponents(degree)).T)] = sums

    @classmethod
    def of_points(cls, points: np.ndarray, degree: int) -> Moments:
        return cls(degree, moment_sums(points, degree))

    @classmethod
    def of_cloud(cls, cloud: DataFrame, degree: int) -> Moments:
        """Partial sums a task, one row of them to the driver."""
        own = exponents(degree)
        if degree <= MAX_COLUMN_DEGREE:
            product = lambda e: F.expr("*".join(["1D", *["x"] * e[0], *["y"] * e[1], *["z"] * e[2]]))
            row = cloud.agg(*[F.sum(product(e)).alias(f"m{k}") for k, e in enumerate(own)]).first()
            return cls(degree, np.array([v or 0.0 for v in row]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(own))
            for b in batches:
                total += moment_sums(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1), degree)
            yield pa.record_batch([pa.array(range(len(own)), pa.int32()), pa.array(total)], names=["at", "value"])

        sums = np.zeros(len(own))
        for at, value in cloud.select("x", "y", "z").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value")).collect():
            sums[at] = value
        return cls(degree, sums)

    @property
    def count(self) -> float:
        return float(self.dense[0, 0, 0])

    @property
    def centre(self) -> np.ndarray:
        return np.array([self.dense[1, 0, 0], self.dense[0, 1, 0], self.dense[0, 0, 1]]) / self.count

    def translated(self, by: np.ndarray) -> Moments:
        """Those of the points plus a vector."""
        out = Moments(self.degree, np.zeros(len(exponents(self.degree))))
        m = self.dense
        for axis, t in enumerate(by):
            pascal = np.array([[comb(a, i) * t ** (a - i) if i <= a else 0.0 for i in range(self.degree + 1)] for a in range(self.degree + 1)])
            m = np.moveaxis(np.tensordot(pascal, m, (1, axis)), 0, axis)
        out.dense = m
        return out

    def products(self, first: list[tuple[int, int, int]], second: list[tuple[int, int, int]]) -> np.ndarray:
        """Sums of products of monomials."""
        both = np.array(first)[:, None, :] + np.array(second)[None, :, :]
        return self.dense[both[..., 0], both[..., 1], both[..., 2]]

    def gram(self, terms: tuple[Term, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of products of terms, and of terms."""
        b = compiled(terms)
        return b.coefficients.T @ self.products(b.exponents, b.exponents) @ b.coefficients, b.coefficients.T @ self.products(b.exponents, [(0, 0, 0)])[:, 0]

    def fit(self, terms: tuple[Term, ...], strength: float = 0.0, weights: np.ndarray | None = None) -> np.ndarray | None:
        g, m = self.gram(terms)
        return solve(g, m, self.count, strength, weights)

    def square_residuals(self, terms: tuple[Term, ...], beta: np.ndarray) -> float:
        """Sum of (f - 1)**2."""
        g, m = self.gram(terms)
        return float(beta @ g @ beta - 2 * beta @ m + self.count)

    def shift(self, terms: tuple[Term, ...], beta: np.ndarray) -> np.ndarray | None:
        """(G'G)^-1 G'e with G the gradients and e = 1 - f; None where that has no solution."""
        b = compiled(terms)
        by_axis = np.stack([c @ beta for c in b.grad_coefficients], 1)
        square = by_axis.T @ self.products(b.grad_exponents, b.grad_exponents) @ by_axis
        if np.linalg.matrix_rank(square) < 3:
            return None
        right = by_axis.T @ (self.products(b.grad_exponents, [(0, 0, 0)])[:, 0] - self.products(b.grad_exponents, b.exponents) @ (b.coefficients @ beta))
        return np.linalg.solve(square, right)


def refine(m: Moments, terms: tuple[Term, ...], steps: int, momentum: float, damping: float, strength: float = 0.0, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Displacement and coefficients after shifts with momentum, from the points' centroid on; m has degree 2 d."""
    start = m.centre
    total, speed = np.zeros(3), np.zeros(3)
    own = m.translated(-start)
    beta = own.fit(terms, strength, weights)
    for _ in range(steps):
        step = None if beta is None else own.shift(terms, beta)
        if step is None:
            break
        speed = momentum * speed + damping * step
        total -= speed
        own = own.translated(speed)
        beta = own.fit(terms, strength, weights)
    return total + start, beta
