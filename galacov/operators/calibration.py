"""Linear algebra on finished covariance matrices, in numpy on the driver: these have as many rows as bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def matrix(table: DataFrame, n: int | None = None) -> np.ndarray:
    """From (row, col, value)."""
    got = table.select("row", "col", "value").toArrow()
    r, c, v = (got.column(i).to_numpy() for i in range(3))
    n = n or (int(max(r.max(), c.max())) + 1 if len(r) else 0)
    out = np.zeros((n, n))
    out[r, c] = v
    return out


def table(spark, a: np.ndarray) -> DataFrame:
    rows, cols = np.indices(a.shape)
    return spark.createDataFrame([(int(r), int(c), float(v)) for r, c, v in zip(rows.ravel(), cols.ravel(), a.ravel(), strict=True)], "row int, col int, value double")


def positive_definite(cov: np.ndarray) -> None:
    low = np.linalg.eigvalsh((cov + cov.T) / 2).min()
    if low <= 0:
        raise ValueError(f"the covariance is not positive definite: its lowest eigenvalue is {low:g}")


def root(a: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T


def converged(c2: np.ndarray, c4: np.ndarray, alpha: float = 1.0) -> dict[str, bool]:
    """Whether the 4-point term's noise is below what the 2-point term can hide: by the lowest eigenvalues and, more
    strictly, relative to the 2-point term."""
    e2, e4 = np.linalg.eigvalsh(c2).min(), np.linalg.eigvalsh(c4).min()
    values, vectors = np.linalg.eigh(c2)
    w = (vectors / np.sqrt(values)) @ vectors.T
    return {"lowest": bool(e4 >= -(alpha**2) * e2), "relative": bool(np.linalg.eigvalsh(w @ c4 @ w).min() > -(alpha**2))}


def bias_matrix(parts: np.ndarray) -> np.ndarray:
    """D = (n - 1) / n (-1 + mean_i C_without_i^-1 C_i) from n partial covariances."""
    n = len(parts)
    total = parts.sum(axis=0)
    mean = np.mean([np.linalg.solve((total - p) / (n - 1), p) for p in parts], axis=0)
    return (n - 1) / n * (mean - np.eye(parts.shape[1]))


def precision(parts: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """D and (1 - D) C^-1."""
    d = bias_matrix(parts)
    return d, (np.eye(len(full)) - d) @ np.linalg.inv(full)


def effective_samples(d: np.ndarray) -> float:
    """(n + 1) / det(D)^(1/n) + 1; 0 where the determinant is negative."""
    sign, log = np.linalg.slogdet(d)
    return 0.0 if sign <= 0 else (len(d) + 1) / np.exp(log / len(d)) + 1


def negative_likelihood(target: np.ndarray, psi: np.ndarray) -> float:
    sign, log = np.linalg.slogdet(psi)
    return np.inf if sign <= 0 else float(np.trace(psi @ target) - log)


def golden(f, low: float, high: float, tol: float = 1e-10) -> float:
    g = (5**0.5 - 1) / 2
    a, b = low, high
    x, y = b - g * (b - a), a + g * (b - a)
    fx, fy = f(x), f(y)
    while b - a > tol * (1 + abs(a) + abs(b)):
        if fx <= fy:
            b, y, fy = y, x, fx
            x = b - g * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = a + g * (b - a)
            fy = f(y)
    return (a + b) / 2


def fit_alpha(target: np.ndarray, c2: np.ndarray, c3: np.ndarray, c4: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, low: float = 0.0, high: float = 8.0) -> float:
    """The shot-noise rescaling that makes the theory covariance the likeliest for the target: the lowest point of a grid,
    then golden section around it. With partial terms the precision is corrected for its bias."""
    def objective(alpha: float) -> float:
        if alpha < 0:
            return np.inf
        full = c4 + alpha * c3 + alpha**2 * c2
        if parts is None:
            return negative_likelihood(target, np.linalg.inv(full))
        p2, p3, p4 = parts
        return negative_likelihood(target, precision(p4 + alpha * p3 + alpha**2 * p2, full)[1])

    while True:  # the range grows until the lowest point lies inside it
        grid = np.linspace(low, high, 161)
        values = np.array([objective(a) for a in grid])
        values = np.where(np.isfinite(values), values, np.inf)
        k = int(values.argmin())
        if np.isfinite(values).any() and k < len(grid) - 1:
            break
        if high > 1e6:
            raise ValueError("no rescaling gives a positive precision" if not np.isfinite(values).any() else "the likelihood rises without end")
        high *= 4
    return golden(objective, grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)])


def r_inv(c1: np.ndarray, c2: np.ndarray) -> float:
    x = np.linalg.solve(c1, c2) - np.eye(len(c1))
    return float(np.sqrt(np.trace(x @ x) / len(c1)))


def kl_divergence(c1: np.ndarray, c2: np.ndarray) -> float:
    x = np.linalg.solve(c1, c2)
    return float((np.trace(x) - len(c1) - np.linalg.slogdet(x)[1]) / 2)


def chi2_reduced(c1: np.ndarray, c2: np.ndarray) -> float:
    return float(np.trace(np.linalg.solve(c1, c2)) / len(c1))


def compared(c1: np.ndarray, c2: np.ndarray) -> dict[str, tuple[float, float]]:
    """Each measure both ways round."""
    return {n: (f(c1, c2), f(c2, c1)) for n, f in (("r_inv", r_inv), ("kl", kl_divergence), ("chi2_red", chi2_reduced))}


def fitted_correction(mu: np.ndarray, phi: np.ndarray, joint: float = 0.75) -> np.ndarray:
    """a0 a1 a2 b0 b1 b2 b3 of the least-squares quadratic below the joint and cubic above it that meet there with the
    same slope. Five numbers are free: a0, a1, a2, b2, b3; the model is linear in them."""
    low = mu < joint
    c, one, zero = joint, np.ones_like(mu), np.zeros_like(mu)
    # b1 = a1 + 2c (a2 - b2) - 3 b3 c^2 and b0 = a0 + (a1 - b1) c + (a2 - b2) c^2 - b3 c^3, put into b0 + b1 mu + b2 mu^2 + b3 mu^3.
    t = mu - c
    columns = [np.where(low, one, one), np.where(low, mu, c + t), np.where(low, mu**2, c**2 + 2 * c * t), np.where(low, zero, t**2), np.where(low, zero, mu**3 - c**3 - 3 * c**2 * t)]
    a0, a1, a2, b2, b3 = np.linalg.lstsq(np.stack(columns, axis=1), phi, rcond=None)[0]
    b1 = a1 + 2 * c * (a2 - b2) - 3 * b3 * c**2
    b0 = a0 + (a1 - b1) * c + (a2 - b2) * c**2 - b3 * c**3
    return np.array([a0, a1, a2, b0, b1, b2, b3])
