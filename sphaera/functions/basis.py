"""Polynomial bases for implicit surfaces, compiled to SQL expressions.

A term is a polynomial in x, y, z: a map from exponents (a, b, c) to a
coefficient. Everything is computed exactly (fractions) up to one square root a
term; no trigonometry reaches the query. The emitted text is valid in Spark SQL
and in ANSI SQL, so values, gradients and Gram sums stay in generated code.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import factorial, sqrt

import numpy as np

Poly = dict[tuple[int, int, int], Fraction]


def _add(p: Poly, q: Poly, scale: Fraction = Fraction(1)) -> Poly:
    out = dict(p)
    for k, v in q.items():
        out[k] = out.get(k, Fraction(0)) + scale * v
    return {k: v for k, v in out.items() if v}


def _mul(p: Poly, q: Poly) -> Poly:
    out: Poly = {}
    for (a, b, c), v in p.items():
        for (d, e, f), w in q.items():
            k = (a + d, b + e, c + f)
            out[k] = out.get(k, Fraction(0)) + v * w
    return {k: v for k, v in out.items() if v}


def _power(p: Poly, n: int) -> Poly:
    out: Poly = {(0, 0, 0): Fraction(1)}
    for _ in range(n):
        out = _mul(out, p)
    return out


_R2: Poly = {(2, 0, 0): Fraction(1), (0, 2, 0): Fraction(1), (0, 0, 2): Fraction(1)}


@dataclass(frozen=True)
class Term:
    """One basis function: level, order within it, kind, and coefficients by exponents."""

    level: int
    m: int
    kind: str
    coefficients: tuple[tuple[tuple[int, int, int], float], ...]

    def derivative(self, axis: int) -> Term:
        out = []
        for k, v in self.coefficients:
            if k[axis]:
                e = list(k)
                e[axis] -= 1
                out.append((tuple(e), v * k[axis]))
        return Term(self.level, self.m, f"{self.kind}_d{'xyz'[axis]}", tuple(out))

    def sql(self, x: str = "x", y: str = "y", z: str = "z") -> str:
        """The value as an expression; a vanished derivative is a plain zero."""
        if not self.coefficients:
            return "0E0"
        parts = []
        for (a, b, c), v in self.coefficients:
            parts.append("*".join([f"{v:.17E}", *[x] * a, *[y] * b, *[z] * c]))
        return "(" + " + ".join(parts) + ")"

    def values(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points))
        for (a, b, c), v in self.coefficients:
            out += v * points[:, 0] ** a * points[:, 1] ** b * points[:, 2] ** c
        return out


@lru_cache
def harmonic_terms(order: int) -> tuple[Term, ...]:
    """Solid harmonics r**(order - l) H_lm for l = order, order - 2, ...; within a level m = 0, then cosine and sine of each m."""
    if order < 0:
        raise ValueError("order must not be negative")
    out = []
    for level in range(order, -1, -2):
        # Legendre polynomial in t, as coefficients by power
        legendre = [Fraction(0)] * (level + 1)
        for k in range(level // 2 + 1):
            legendre[level - 2 * k] = Fraction((-1) ** k * factorial(2 * level - 2 * k), 2**level * factorial(k) * factorial(level - k) * factorial(level - 2 * k))
        for m in range(level + 1):
            derived = legendre
            for _ in range(m):
                derived = [derived[j] * j for j in range(1, len(derived))] or [Fraction(0)]
            polar: Poly = {}
            for j, v in enumerate(derived):
                if v:  # t**j r**(level - m): z**j times an even power of r
                    polar = _add(polar, _mul({(0, 0, j): v}, _power(_R2, (level - m - j) // 2)))
            polar = _mul(polar, _power(_R2, (order - level) // 2))
            real, imaginary = {(0, 0, 0): Fraction(1)}, {}
            for _ in range(m):  # times x + iy
                real, imaginary = _add(_mul(real, {(1, 0, 0): Fraction(1)}), _mul(imaginary, {(0, 1, 0): Fraction(1)}), Fraction(-1)), _add(_mul(imaginary, {(1, 0, 0): Fraction(1)}), _mul(real, {(0, 1, 0): Fraction(1)}))
            scale = sqrt(Fraction(factorial(level - m), factorial(level + m)) * (2 if m else 1))
            for kind, part in (("cos", real), ("sin", imaginary)) if m else (("zonal", real),):
                own = _mul(polar, part)
                out.append(Term(level, m, kind, tuple(sorted((k, float(v) * scale) for k, v in own.items()))))
    return tuple(out)


@lru_cache
def monomial_terms(order: int) -> tuple[Term, ...]:
    """Plain monomials of one degree: permutations of each split of it, first occurrences only."""
    seen: dict[tuple[int, int, int], None] = {}
    for a in range(order, -1, -1):
        for b in range(order - a, -1, -1):
            c = order - a - b
            if a >= b >= c:
                for k in permutations((a, b, c)):
                    seen.setdefault(k)
    return tuple(Term(order, 0, "monomial", ((k, 1.0),)) for k in seen)


def gradient_sql(terms: tuple[Term, ...], **names: str) -> tuple[list[str], list[str], list[str]]:
    return tuple([t.derivative(axis).sql(**names) for t in terms] for axis in range(3))


class Compiled:
    """A basis as matrices over monomials: values and gradients are products with them."""

    def __init__(self, terms: tuple[Term, ...]):
        self.terms = terms
        self.exponents, self.coefficients = self._over([dict(t.coefficients) for t in terms])
        derived = [[dict(t.derivative(axis).coefficients) for t in terms] for axis in range(3)]
        self.grad_exponents, flat = self._over([d for own in derived for d in own])
        self.grad_coefficients = [flat[:, k * len(terms) : (k + 1) * len(terms)] for k in range(3)]

    @staticmethod
    def _over(polys: list[dict]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        exponents = sorted({e for p in polys for e in p})
        place = {e: i for i, e in enumerate(exponents)}
        out = np.zeros((len(exponents), len(polys)))
        for k, p in enumerate(polys):
            for e, v in p.items():
                out[place[e], k] = v
        return exponents, out

    @staticmethod
    def monomials(exponents: list[tuple[int, int, int]], points: np.ndarray) -> np.ndarray:
        """Values (n, monomials), each a product of powers computed once."""
        top = max((max(e) for e in exponents), default=0)
        powers = np.ones((top + 1, 3, len(points)))
        for k in range(1, top + 1):
            np.multiply(powers[k - 1], points.T, out=powers[k])
        out = np.empty((len(exponents), len(points)))
        for row, (a, b, c) in zip(out, exponents):
            np.multiply(powers[a, 0], powers[b, 1], out=row)
            if c:
                row *= powers[c, 2]
        return out.T

    def design(self, points: np.ndarray) -> np.ndarray:
        return self.monomials(self.exponents, points) @ self.coefficients

    def value(self, points: np.ndarray, beta: np.ndarray) -> np.ndarray:
        return self.monomials(self.exponents, points) @ (self.coefficients @ beta)

    def gradient(self, points: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """Gradients (n, 3) of sum beta phi."""
        return self.monomials(self.grad_exponents, points) @ np.stack([c @ beta for c in self.grad_coefficients], 1)


@lru_cache
def compiled(terms: tuple[Term, ...]) -> Compiled:
    return Compiled(terms)


def design(terms: tuple[Term, ...], points: np.ndarray) -> np.ndarray:
    """Values of all terms at points (n, 3)."""
    return compiled(terms).design(points) if len(points) else np.zeros((0, len(terms)))


def penalty(terms: tuple[Term, ...], order: int, s: float = 1.0) -> np.ndarray:
    """Sobolev weights [l(l + 1) / (order(order + 1))]**s; level 0 is free."""
    top = order * (order + 1)
    return np.array([(t.level * (t.level + 1) / top) ** s if t.level else 0.0 for t in terms])


def ridge_diagonal(order: int, strength: float | list[float], s: float = 1.0) -> np.ndarray:
    """Penalty by term: one strength scaled by level, or one value for each level from the highest on."""
    levels = list(range(order, -1, -2))
    if np.isscalar(strength):
        by_level = [strength * (v * (v + 1)) ** s / (order * (order + 1)) ** s for v in levels]
    else:
        if len(strength) != len(levels):
            raise ValueError(f"needs {len(levels)} values, one for each level of {levels}")
        by_level = list(strength)
    return np.repeat(by_level, [2 * v + 1 for v in levels]).astype(float)
