"""Bins of µ and Legendre multipoles."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galacov.functions import geometry


def mu_factors(spark, n_mu: int, max_l: int, inverse: bool = False) -> DataFrame:
    """mu_bin, l, factor: (2l + 1) times the integral of P_l over the bin, or with inverse the bin's mean of P_l."""
    bins = spark.range(n_mu).select(F.col("id").cast("int").alias("mu_bin"), (F.col("id") / n_mu).alias("lo"), ((F.col("id") + 1) / n_mu).alias("hi"))

    def of(l: int) -> DataFrame:
        whole = geometry.legendre_integral(l, F.col("lo"), F.col("hi"))
        return bins.select("mu_bin", F.lit(l).alias("l"), (whole / (F.col("hi") - F.col("lo")) if inverse else whole * (2 * l + 1)).alias("factor"))

    return reduce(DataFrame.unionByName, [of(l) for l in range(0, max_l + 1, 2)])


def to_multipoles(xi: DataFrame, factors: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, r_bin, mu_bin, xi) to (keys, r_bin, l, xi_l)."""
    return xi.join(F.broadcast(factors), "mu_bin").groupBy(*keys, "r_bin", "l").agg(F.sum(F.col("xi") * F.col("factor")).alias("xi_l"))


def from_multipoles(xi_l: DataFrame, inverse: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return xi_l.join(F.broadcast(inverse), "l").groupBy(*keys, "r_bin", "mu_bin").agg(F.sum(F.col("xi_l") * F.col("factor")).alias("xi"))


def savgol_weights(window: int, order: int) -> list[float]:
    """Of the value at the centre of the least-squares polynomial over an odd window."""
    h = window // 2
    x = np.arange(-h, h + 1, dtype=float)
    return np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0].tolist()


def savgol_edge(window: int, order: int) -> np.ndarray:
    """Rows: weights of the first window's values for the fit at its first window // 2 places."""
    x = np.arange(window, dtype=float)
    v = np.vander(x, order + 1, increasing=True)
    return v[: window // 2] @ np.linalg.pinv(v)


def smoothed(xi_l: DataFrame, r: dict[int, float], window: int, order: int) -> DataFrame:
    """Savitzky-Golay over radial bins of r^2 xi_l, one series a multipole; ends take the end windows' fits."""
    n, h = len(r), window // 2
    if window % 2 == 0 or window > n:
        raise ValueError("the window must be odd and no longer than the series")
    table = F.create_map(*[F.lit(v) for k in r.items() for v in (int(k[0]), float(k[1]))])
    own = xi_l.withColumn("__r2", table[F.col("r_bin")] * table[F.col("r_bin")])
    series = Window.partitionBy("l").orderBy("r_bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("__all", F.collect_list(F.col("__r2") * F.col("xi_l")).over(series)).withColumn("__k", F.row_number().over(Window.partitionBy("l").orderBy("r_bin")) - 1)
    inner, edge = savgol_weights(window, order), savgol_edge(window, order)
    at = lambda i: F.element_at("__all", i.cast("int"))
    middle = reduce(lambda a, b: a + b, [F.lit(w) * at(F.col("__k") - h + j + 1) for j, w in enumerate(inner)])
    value = F.when((F.col("__k") >= h) & (F.col("__k") < n - h), middle)
    for i in range(h):
        low = reduce(lambda a, b: a + b, [F.lit(float(w)) * at(F.lit(j + 1)) for j, w in enumerate(edge[i])])
        high = reduce(lambda a, b: a + b, [F.lit(float(w)) * at(F.lit(n - j)) for j, w in enumerate(edge[i])])
        value = value.when(F.col("__k") == i, low).when(F.col("__k") == n - 1 - i, high)
    return own.withColumn("xi_l", value / F.col("__r2")).drop("__r2", "__all", "__k")


def midpoints(edges: DataFrame, by: str = "edge") -> DataFrame:
    """k, mid: means of adjacent edges."""
    order = Window.orderBy(by)
    return edges.select((F.row_number().over(order) - 1).alias("k"), ((F.col(by) + F.lead(by).over(order)) / 2).alias("mid")).where("mid is not null")


def trapezoid(series: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the integral of y over x by trapezoids."""
    order = Window.orderBy(x)
    step = (F.lead(x).over(order) - F.col(x)) * (F.lead(y).over(order) + F.col(y)) / 2
    return series.select(step.alias("v")).agg(F.sum("v").alias("integral"))
