"""The correlation function between the nodes of its table: bicubic in (µ, r) of r^2 xi, with a tail and a smooth start."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def slopes(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Derivatives of a natural cubic spline along the last axis."""
    n = len(x)
    if n == 1:
        return np.zeros_like(y)
    if n == 2:
        return np.repeat((y[..., 1:] - y[..., :1]) / (x[1] - x[0]), 2, axis=-1)
    h = np.diff(x)
    a = np.zeros((n, n))
    rhs = np.zeros(y.shape)
    d = np.diff(y, axis=-1) / h
    a[0, 0], a[0, 1] = 2, 1
    rhs[..., 0] = 3 * d[..., 0]
    for i in range(1, n - 1):
        a[i, i - 1], a[i, i], a[i, i + 1] = 1 / h[i - 1], 2 * (1 / h[i - 1] + 1 / h[i]), 1 / h[i]
        rhs[..., i] = 3 * (d[..., i - 1] / h[i - 1] + d[..., i] / h[i])
    a[-1, -2], a[-1, -1] = 1, 2
    rhs[..., -1] = 3 * d[..., -1]
    return np.moveaxis(np.linalg.solve(a, np.moveaxis(rhs, -1, 0).reshape(n, -1)).reshape(n, *y.shape[:-1]), 0, -1)


def hermite(t, f0, f1, d0, d1, h):
    return f0 * (1 + 2 * t) * (1 - t) ** 2 + d0 * h * t * (1 - t) ** 2 + f1 * t**2 * (3 - 2 * t) + d1 * h * t**2 * (t - 1)


@dataclass
class CorrelationFunction:
    """r: nodes (all > 0), mu: nodes, xi[r, mu]. A node at r = 0 with r^2 xi = 0 is added."""

    r: np.ndarray
    mu: np.ndarray
    xi: np.ndarray
    mu_range: tuple[float, float] = (0.0, 1.0)

    def __post_init__(self):
        self.r, self.mu = np.asarray(self.r, float), np.asarray(self.mu, float)
        self.xi = np.asarray(self.xi, float)
        if self.xi.shape != (len(self.r), len(self.mu)) or (np.diff(self.r) <= 0).any() or (np.diff(self.mu) <= 0).any() or self.r[0] <= 0:
            raise ValueError("a table of xi needs rising nodes and one value for each pair of them")
        self.x = np.concatenate([[0.0], self.r])
        self.z = np.vstack([np.zeros(len(self.mu)), self.xi * (self.r**2)[:, None]])
        self.zr = slopes(self.z.T, self.x).T
        self.zm = slopes(self.z, self.mu)
        self.zrm = slopes(self.zr, self.mu)
        mean = self.z.mean(axis=1)
        self.mean, self.mean_slope = mean, slopes(mean, self.x)

    def _z(self, r: np.ndarray, mu: np.ndarray) -> np.ndarray:
        i = np.clip(np.searchsorted(self.x, r, side="right") - 1, 0, len(self.x) - 2)
        h = self.x[i + 1] - self.x[i]
        t = (r - self.x[i]) / h
        if len(self.mu) == 1:
            return hermite(t, self.z[i, 0], self.z[i + 1, 0], self.zr[i, 0], self.zr[i + 1, 0], h)
        j = np.clip(np.searchsorted(self.mu, mu, side="right") - 1, 0, len(self.mu) - 2)
        g = self.mu[j + 1] - self.mu[j]
        u = (mu - self.mu[j]) / g
        at = lambda k: hermite(t, self.z[i, k], self.z[i + 1, k], self.zr[i, k], self.zr[i + 1, k], h)
        slope = lambda k: hermite(t, self.zm[i, k], self.zm[i + 1, k], self.zrm[i, k], self.zrm[i + 1, k], h)
        return hermite(u, at(j), at(j + 1), slope(j), slope(j + 1), g)

    def __call__(self, r, mu) -> np.ndarray:
        r, mu = np.broadcast_arrays(np.asarray(r, float), np.asarray(mu, float))
        mu = np.clip(mu, *self.mu_range)
        low, high = self.r[0], self.r[-1]
        inside = np.clip(r, low / 2, high)
        value = self._z(inside, mu) / inside**2
        value = np.where(r > high, value * (r / high) ** -4.0, value)
        y = np.clip((low - r) / (low / 2), 0, 1)
        share = y**3 * (10 - 15 * y + 6 * y**2)
        start = self._z(np.full(r.shape, low / 2), mu) / (low / 2) ** 2
        return np.where(r < low, share * start + (1 - share) * value, value)

    def isotropic(self, r) -> np.ndarray:
        """xi(r) from the mean over mu of r^2 xi."""
        r = np.asarray(r, float)
        low, high = self.r[0], self.r[-1]

        def z(q):
            i = np.clip(np.searchsorted(self.x, q, side="right") - 1, 0, len(self.x) - 2)
            h = self.x[i + 1] - self.x[i]
            return hermite((q - self.x[i]) / h, self.mean[i], self.mean[i + 1], self.mean_slope[i], self.mean_slope[i + 1], h)

        inside = np.clip(r, low / 2, high)
        return np.where(r > high, z(inside) / inside**2 * (r / high) ** -4.0, z(inside) / inside**2)

    def column(self, s: Column, mu: Column) -> Column:
        """As a column; the table's coefficients travel with the function."""
        @F.pandas_udf("double")
        def value(s: pd.Series, mu: pd.Series) -> pd.Series:
            return pd.Series(self(s.to_numpy(), mu.to_numpy()))

        return value(s, mu)
