"""Power-spectrum terms: pairs inside a window, weighted with Legendre moments of spherical Bessel kernels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galacov.functions import geometry
from galacov.operators import tuples


def sine_integral(x) -> np.ndarray:
    """Si(x) by Gauss-Legendre quadrature of sin(t) / t over pieces of about pi."""
    x = np.atleast_1d(np.asarray(x, float))
    nodes, weight = np.polynomial.legendre.leggauss(16)
    out = np.zeros(x.shape)
    for i, v in enumerate(x.ravel()):
        pieces = max(1, int(np.ceil(abs(v) / np.pi)))
        edge = np.linspace(0, v, pieces + 1)
        half = (edge[1:] - edge[:-1])[:, None] / 2
        t = edge[:-1, None] + half * (1 + nodes)
        out.ravel()[i] = (half * weight * np.sinc(t / np.pi)).sum()
    return out


def antiderivative(l: int, x) -> np.ndarray:
    """Of x^2 j_l(x) from 0, l = 0, 2, 4, 6, by quadrature of the spherical Bessel function's closed form."""
    x = np.atleast_1d(np.asarray(x, float))
    nodes, weight = np.polynomial.legendre.leggauss(16)
    out = np.zeros(x.shape)
    for i, v in enumerate(x.ravel()):
        pieces = max(1, int(np.ceil(abs(v) / 2)))
        edge = np.linspace(0, v, pieces + 1)
        half = (edge[1:] - edge[:-1])[:, None] / 2
        t = edge[:-1, None] + half * (1 + nodes)
        out.ravel()[i] = (half * weight * t**2 * spherical_bessel(l, t)).sum()
    return out


def spherical_bessel(l: int, x) -> np.ndarray:
    """By upward recurrence where x is large, by its series where it is small."""
    x = np.asarray(x, float)
    near = np.abs(x) < max(1.0, l)
    y = np.where(near, max(1.0, float(l)) + 1, x)
    a, b = np.sin(y) / y, np.sin(y) / y**2 - np.cos(y) / y
    for k in range(1, l):
        a, b = b, (2 * k + 1) / y * b - a
    far = a if l == 0 else b
    term = np.ones_like(x)
    for k in range(1, l + 1):
        term = term * x / (2 * k + 1)
    total, t = term.copy(), term.copy()
    for k in range(1, 40):
        t = -t * x**2 / (2 * k * (2 * l + 2 * k + 1))
        total = total + t
    return np.where(near, total, far)


def shell_mean(l: int, k_low: float, k_high: float, r: np.ndarray) -> np.ndarray:
    """Mean of j_l(k r) over a shell of k: 3 [F(k_high r) - F(k_low r)] / (r^3 (k_high^3 - k_low^3))."""
    return 3 * (antiderivative(l, k_high * r) - antiderivative(l, k_low * r)) / (r**3 * (k_high**3 - k_low**3))


def shell_table(l: int, k_low: float, k_high: float, r_max: float, degree: int = 24) -> Callable[[np.ndarray], np.ndarray]:
    """shell_mean from 0 to r_max through Chebyshev polynomials over pieces of 4 / k_high, made once and sent along; their
    error is that of rounding."""
    pieces = max(1, int(np.ceil(k_high * r_max / 4)))
    h = r_max / pieces
    own = [np.polynomial.chebyshev.chebinterpolate(lambda t, k=k: shell_mean(l, k_low, k_high, (t + 1) * h / 2 + k * h), degree) for k in range(pieces)]
    coef = np.array(own).T.copy()

    def value(r: np.ndarray) -> np.ndarray:
        r = np.clip(np.nan_to_num(r), 0, r_max)
        at = np.minimum((r / h).astype(np.int64), pieces - 1)
        t = 2 * (r - at * h) / h - 1
        one, two = np.zeros_like(t), np.zeros_like(t)
        for c in coef[:0:-1]:  # Clenshaw's recurrence
            one, two = 2 * t * one - two + c[at], one
        return t * one - two + coef[0][at]

    return value


def shell_kernel(l: int, k_low: float, k_high: float, r_max: float) -> Callable[[Column], Column]:
    """shell_mean as a function of a column r, up to r_max."""
    table = shell_table(l, k_low, k_high, r_max)

    def column(r: Column) -> Column:
        @F.pandas_udf("double")
        def value(r: pd.Series) -> pd.Series:
            return pd.Series(table(r.to_numpy(float)))

        return value(r)

    return column


def inverse_phi(s: np.ndarray, mu: np.ndarray, coef: tuple) -> np.ndarray:
    """geometry.inverse_phi of arrays, by powers: where it crosses 0 its last digits are seen in its inverse, and so in sums."""
    total = 0.0
    for k in range(3):
        powers = [(n, c) for n, c in reversed(list(enumerate(geometry.legendre_coefficients(2 * k)))) if c]
        p = 0.0
        for n, c in powers:
            p = p + (c * mu**n if n > 2 else c * mu * mu if n == 2 else c)
        for n in range(3):
            total = total + (p * coef[3 * k + n] if n == 0 else p * coef[3 * k + n] * s if n == 1 else p * coef[3 * k + n] * s * s)
    return total


def leg_of(bins, r0: float, shells: list[tuple[float, float]], max_l: int, coef: tuple | None = None) -> tuples.Leg:
    """Legs for operators.tuples: the columns of sides(), shell x multipoles + l / 2, as arrays."""
    ls = list(range(0, max_l + 1, 2))
    kernels = [[shell_table(l, *shell, r0) for l in ls] for shell in shells]

    def factors(s, mu):
        x = s / r0
        y, z = 2 * x - 1, x - 1
        window = np.where(x < 0.5, 1.0, np.where(x < 0.75, 1 - 8 * y * y * y + 8 * y * y * y * y, -64 * z * z * z - 128 * z * z * z * z))
        if coef is not None:
            window = window / inverse_phi(s, mu, coef)
        angle = [tuples.legendre(l, mu) * (2 * l + 1) for l in ls]
        return x <= 1, np.stack([window * kernel(s) * p for own in kernels for kernel, p in zip(own, angle, strict=True)])

    return tuples.windowed(bins, factors, len(shells) * len(ls))


def placed(sums: DataFrame, max_l: int) -> DataFrame:
    """k_a, p, k_b, q, value of sums by columns a and b."""
    n = max_l // 2 + 1
    shell, l = (lambda c: F.expr(f"cast({c} div {n} as int)")), (lambda c: (F.col(c) % n * 2).cast("int"))
    return sums.select(shell("a").alias("k_a"), l("a").alias("p"), shell("b").alias("k_b"), l("b").alias("q"), "value")


def sides(s: str, mu: str, r0: float, shells: list[tuple[float, float]], max_l: int, coef: Column | None = None) -> Column:
    """Of a pair inside the window: (k, l, f) for each shell and even multipole, f = W K_kl(s) P_l(mu) (2l + 1) / (1/Phi);
    null outside. coef: of geometry.inverse_phi, none for Phi = 1."""
    window = geometry.pair_window(F.col(s), r0)
    if coef is not None:
        window = window / geometry.inverse_phi(F.col(s), F.col(mu), coef)
    parts = F.array(*[F.struct(F.lit(a).alias("k"), F.lit(l).alias("l"), (window * shell_kernel(l, *shells[a], r0)(F.col(s)) * geometry.legendre(l, F.col(mu)) * (2 * l + 1)).alias("f"))
                      for a in range(len(shells)) for l in range(0, max_l + 1, 2)])
    return F.when(geometry.pair_window(F.col(s), r0).isNotNull(), parts)


def moments(tuples: DataFrame, value: Column, one: Column, two: Column) -> DataFrame:
    """k_a, p, k_b, q, value: sums of value x f of the first pair x f of the second, over tuples whose pairs both lie inside
    the window."""
    met = tuples.select(value.alias("v"), one.alias("x"), two.alias("y")).where("x is not null and y is not null")
    met = met.select("v", F.explode("x").alias("a"), "y").select("v", "a", F.explode("y").alias("b"))
    return met.groupBy(F.col("a.k").alias("k_a"), F.col("a.l").alias("p"), F.col("b.k").alias("k_b"), F.col("b.l").alias("q")).agg(F.sum(F.col("v") * F.col("a.f") * F.col("b.f")).alias("value"))


def two_point_term(leg: DataFrame, r0: float, shells: list[tuple[float, float]], max_l: int, norm: float = 1.0, coef: Column | None = None) -> DataFrame:
    """2 sum w_i^2 w_j^2 (1 + xi) / norm^2 with the pair's moments on either side. leg: terms.legs."""
    v = 2 * F.col("w_i") * F.col("w_i") * F.col("w_j") * F.col("w_j") * (1 + F.col("xi")) / norm**2
    own = sides("s", "mu", r0, shells, max_l, coef)
    return moments(leg, v, own, own)


def three_point_term(triple: DataFrame, r0: float, shells: list[tuple[float, float]], max_l: int, norm: float = 1.0, coef: Column | None = None) -> DataFrame:
    """4 sum w_i w_j^2 w_k xi_ik / norm^3 with the moments of ij and jk. triple: terms.triples."""
    v = 4 * F.col("w_i") * F.col("w_j") * F.col("w_j") * F.col("w_k") * F.col("x") / norm**3
    return moments(triple, v, sides("s", "mu", r0, shells, max_l, coef), sides("s_b", "mu_b", r0, shells, max_l, coef))


def four_point_term(quad: DataFrame, r0: float, shells: list[tuple[float, float]], max_l: int, norm: float = 1.0, coef: Column | None = None) -> DataFrame:
    """2 sum w_i w_j w_k w_l xi_ik xi_jl / norm^4 with the moments of ij and kl. quad: terms.quads."""
    v = 2 * F.col("w_i") * F.col("w_j") * F.col("w_k") * F.col("w_l") * F.col("x") * F.col("y") / norm**4
    return moments(quad, v, sides("s", "mu", r0, shells, max_l, coef), sides("s_b", "mu_b", r0, shells, max_l, coef))
