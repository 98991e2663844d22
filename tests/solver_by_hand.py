"""Brute force for the solver: the whole loop over a matrix of points, one iteration after the other."""

import time
from collections.abc import Iterator

import numpy as np

from sphaera.functions.basis import compiled, penalty
from sphaera.operators.linalg import solve
from sphaera.operators.ransac import FIRST_BEST, FIRST_MASS, FIRST_OMEGA, Config, draws, theoretical_n


class Solver:
    """Fits and refinements in NumPy for one basis."""

    def __init__(self, c: Config):
        self.c, self.terms = c, c.basis
        self.basis = compiled(self.terms)
        self.weights = penalty(self.terms, c.order)

    def fit(self, points: np.ndarray) -> np.ndarray | None:
        phi = self.basis.design(points)
        return solve(phi.T @ phi, phi.sum(0), len(points), self.c.strength, self.weights)

    def refine(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Displacement and coefficients after loc_iters shifts with momentum, from the centroid of points on."""
        start = points.mean(0)
        at, total, speed = points - start, np.zeros(3), np.zeros(3)
        beta = self.fit(at)
        for _ in range(self.c.loc_iters):
            if beta is None:
                break
            g = self.basis.gradient(at, beta)
            e = 1 - self.basis.value(at, beta)
            square = g.T @ g
            if np.linalg.matrix_rank(square) < 3:
                break
            speed = self.c.momentum * speed + self.c.damping * np.linalg.solve(square, g.T @ e)
            total, at = total - speed, at + speed
            beta = self.fit(at)
        return total + start, beta

    def residual(self, points: np.ndarray, beta: np.ndarray) -> np.ndarray:
        return np.abs(self.basis.value(points, beta) - 1)

    def score(self, r: np.ndarray) -> float:
        return float(np.exp(-(r**2) / (2 * self.c.sigma**2)).mean())


def one_iteration(s: Solver, points: np.ndarray, truth: np.ndarray | None, chosen: np.ndarray, best: float, omega: np.ndarray | None) -> dict:
    """Everything one draw gives; what is skipped below the gate stays NaN or None."""
    c, nan, began = s.c, float("nan"), time.perf_counter()
    row = dict.fromkeys(("post_score", "inlier_ratio", "mse_all", "mse_inlier", "beta_norm", "tp", "fp", "fn", "tn", "precision", "recall", "f1"), nan)
    row |= {"disp": None, "beta": None, "singular": False, "soft": None, "mass": nan, "raw_ms": None, "loc_ms": None}
    sample = points[chosen]
    moved = points - sample.mean(0)
    beta = s.fit(sample - sample.mean(0))
    if beta is None:
        return row | {"pre_score": nan, "singular": True}
    r = s.residual(moved, beta)
    row["pre_score"] = s.score(r)
    row["raw_ms"], began = 1000 * (time.perf_counter() - began), time.perf_counter()
    if not row["pre_score"] >= best * c.update_thresh:
        return row
    inside = r < c.thresh
    row["mass"] = float(inside.mean() if omega is None else omega[inside].sum() / omega.sum())
    if not inside.any():
        return row
    disp, beta = s.refine(points[inside])
    if beta is None:
        return row | {"singular": True}
    r = s.residual(points - disp, beta)
    inside = r < c.thresh
    soft = np.exp(-(r**2) / (2 * c.sigma**2))
    row |= {"post_score": float(soft.mean()), "soft": soft, "disp": disp.tolist(), "beta": beta.tolist(), "beta_norm": float(beta @ beta), "inlier_ratio": float(inside.mean())}
    row |= {"mse_all": float((r**2).mean()), "mse_inlier": float((r[inside] ** 2).mean()) if inside.any() else nan}
    if truth is not None and len(truth) == len(inside):
        tp, fp, fn = (float(x.sum()) for x in (truth & inside, ~truth & inside, truth & ~inside))
        p, q = tp / max(1, tp + fp), tp / max(1, tp + fn)
        row |= {"tp": tp, "fp": fp, "fn": fn, "tn": float((~truth & ~inside).sum()), "precision": p, "recall": q, "f1": 2 * p * q / max(1e-12, p + q)}
    row["loc_ms"] = 1000 * (time.perf_counter() - began)
    return row


def iterate(c: Config, points: np.ndarray, truth: np.ndarray | None) -> Iterator[dict]:
    """The adaptive loop: sampling weights, inlier mass, bound on iterations and best score carry over.

    Unless the bound is frozen, it starts at what the first w implies and later falls with twice that number.
    """
    s, n = Solver(c), len(points)
    omega, mass = np.full(n, FIRST_OMEGA), FIRST_MASS
    w, best, limit = c.min_inlier_ratio, FIRST_BEST, float(c.max_iter)
    if not c.freeze_iter:
        limit = min(limit, theoretical_n(w, c.sample_size, c.conf))
    for i in range(1, int(limit) + 1):
        u = draws(c.seed, np.array([i]), c.sample_size)[0]
        edges = np.cumsum(omega)
        chosen = np.minimum(np.searchsorted(edges, u * edges[-1], "right"), n - 1)
        row = one_iteration(s, points, truth, chosen, best, omega)
        if not np.isnan(row["mass"]):
            if not c.freeze_w:
                w = c.ema * w + (1 - c.ema) * row["mass"]
            if not c.freeze_iter:
                limit = min(limit, 2 * theoretical_n(w, c.sample_size, c.conf))
        if row["soft"] is not None:
            if not c.freeze_omega:
                omega = (mass * omega + row["post_score"] * row["soft"]) / (mass + row["post_score"])
                mass += row["post_score"]
            best = max(best, row["post_score"])
        yield row | {"iter_no": i, "w": w, "max_n": 2 * theoretical_n(w, c.sample_size, c.conf), "max_iter": limit}
        if i >= limit:
            return
