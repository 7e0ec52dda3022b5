"""Column expressions of pair geometry, bins, polynomials and survey corrections. No UDF: all stays in generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: µ below which a survey correction is a quadratic, above which a cubic.
MU_JOIN = 0.75


def square(c: Column) -> Column:
    return c * c


def separation(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def mu_to_observer(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """|cos| of the angle between a - b and a + b, the observer being at the origin."""
    d = [p - q for p, q in zip(a, b, strict=True)]
    m = [p + q for p, q in zip(a, b, strict=True)]
    dot = reduce(lambda s, t: s + t, [p * q for p, q in zip(d, m, strict=True)])
    return F.abs(dot) / (separation(*d) * separation(*m))


def mu_along_z(dz: Column, s: Column) -> Column:
    """For a periodic box: the line of sight is the z axis."""
    return F.abs(dz) / s


def minimum_image(d: Column, box: float) -> Column:
    return d - F.lit(box) * F.round(d / F.lit(box))


def radial_bin(s: Column, edges: Sequence[tuple[float, float]]) -> Column:
    """Index of the half-open interval [low, high) that holds s; null in gaps and outside."""
    out = None
    for i, (lo, hi) in enumerate(edges):
        hit = (s >= F.lit(float(lo))) & (s < F.lit(float(hi)))
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out if out is not None else F.lit(None).cast("int")


def uniform_bin(v: Column, low: float, high: float, n: int) -> Column:
    """Linear bins on [low, high); the value high itself falls into the last bin."""
    i = F.floor((v - F.lit(float(low))) / F.lit((high - low) / n)).cast("int")
    return F.when((v >= low) & (v <= high), F.least(i, F.lit(n - 1)))


def linear_edges(low: float, high: float, n: int) -> list[tuple[float, float]]:
    step = (high - low) / n
    return [(low + i * step, low + (i + 1) * step) for i in range(n)]


def legendre_coefficients(l: int) -> list[float]:
    """Of P_l, by powers: 2^-l sum_k (-1)^k C(l, k) C(2l - 2k, l) x^(l - 2k)."""
    out = [0.0] * (l + 1)
    for k in range(l // 2 + 1):
        out[l - 2 * k] = (-1) ** k * math.comb(l, k) * math.comb(2 * l - 2 * k, l) / 2**l
    return out


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Horner's scheme."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(c))
    return out


def legendre(l: int, x: Column) -> Column:
    return polynomial(x, legendre_coefficients(l))


def legendre_integral(l: int, a: Column, b: Column) -> Column:
    """Integral of P_l from a to b, by its antiderivative."""
    anti = [0.0] + [c / (i + 1) for i, c in enumerate(legendre_coefficients(l))]
    return polynomial(b, anti) - polynomial(a, anti)


def survey_correction(mu: Column, coef: Column) -> Column:
    """From coef = a0 a1 a2 b0 b1 b2 b3: quadratic below MU_JOIN, cubic from there."""
    c = [coef[i] for i in range(7)]
    return F.when(mu < MU_JOIN, c[0] + mu * (c[1] + mu * c[2])).otherwise(c[3] + mu * (c[4] + mu * (c[5] + mu * c[6])))


def inverse_phi(r: Column, mu: Column, coef: Column) -> Column:
    """1 / Phi = sum over even l of P_l(mu) (c0 + c1 r + c2 r^2); coef: an array of three numbers for each l = 0, 2, 4."""
    out = None
    for k in range(3):
        c = [coef[3 * k + i] for i in range(3)]
        part = legendre(2 * k, mu) * (c[0] + r * (c[1] + r * c[2]))
        out = part if out is None else out + part
    return out


def pair_window(r: Column, r0: float) -> Column:
    """Piecewise quartic that falls from 1 to 0 between r0 / 2 and r0; null beyond."""
    x = r / F.lit(float(r0))
    y, z = 2 * x - 1, x - 1
    low, mid, high = F.lit(1.0), 1 - 8 * y * y * y + 8 * y * y * y * y, -64 * z * z * z - 128 * z * z * z * z
    return F.when(x < 0.5, low).when(x < 0.75, mid).when(x <= 1, high)


def shell_volume(lo: Column, hi: Column) -> Column:
    return F.lit(4 * math.pi / 3) * (hi * hi * hi - lo * lo * lo)


def triangle_cosine(opposite: Column, a: Column, b: Column) -> Column:
    """Cosine of the angle between sides a and b."""
    return (a * a + b * b - opposite * opposite) / (2 * a * b)
