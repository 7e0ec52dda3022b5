"""Bin-averaged correlation functions made into ones whose bin averages are the input, by repeated averaging."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galacov.functions.interpolation import CorrelationFunction
from galacov.operators import pairs as pairing

#: Parts of a bin along s and mu over which pairs are summed once.
PARTS = (32, 16)


def histogram(points: DataFrame, bins: pairing.Bins, box: float | None = None, parts: tuple[int, int] = PARTS) -> DataFrame:
    """r_bin, mu_bin, i, j (parts of the bin), w (sum of the pairs' weights), s and mu (their weighted means): a row for
    each part, whatever the catalog."""
    met = pairing.binned(pairing.pairs(points, points, bins.r_max, bins.r_min, box, same=True, ordered=False), bins)
    table = F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b - a)).alias("size")) for a, b in bins.edges])
    edge, step = F.element_at(table, F.col("r_bin") + 1), (bins.mu_high - bins.mu_low) / bins.n_mu
    i = F.least(F.floor((F.col("s") - edge["lo"]) / edge["size"] * parts[0]), F.lit(parts[0] - 1)).cast("int")
    j = F.least(F.floor((F.col("mu") - bins.mu_low - F.col("mu_bin") * step) / step * parts[1]), F.lit(parts[1] - 1)).cast("int")
    w = F.col("w1") * F.col("w2")
    sums = met.groupBy("r_bin", "mu_bin", i.alias("i"), j.alias("j")).agg(F.sum(w).alias("w"), F.sum(w * F.col("s")).alias("ws"), F.sum(w * F.col("mu")).alias("wm"))
    return sums.where("w > 0").select("r_bin", "mu_bin", "i", "j", "w", (F.col("ws") / F.col("w")).alias("s"), (F.col("wm") / F.col("w")).alias("mu"))


def refined(points: DataFrame, bins: pairing.Bins, target: np.ndarray, iterations: int = 8, box: float | None = None, parts: tuple[int, int] = PARTS) -> CorrelationFunction:
    """target[r, mu]: averages over bins. Pairs are summed once over fine parts of the bins; each turn averages the present
    function over these and scales the value at each bin's centre by target / average."""
    got = histogram(points, bins, box, parts).toArrow()
    r_bin, mu_bin, w, s, m = (got.column(c).to_numpy() for c in ("r_bin", "mu_bin", "w", "s", "mu"))
    place = r_bin * bins.n_mu + mu_bin
    total = np.bincount(place, w, target.size)
    if (total == 0).any():
        raise ValueError("a bin has no pairs")
    r = np.array([(lo + hi) / 2 for lo, hi in bins.edges])
    mu = bins.mu_low + (np.arange(bins.n_mu) + 0.5) * (bins.mu_high - bins.mu_low) / bins.n_mu
    now = CorrelationFunction(r, mu, target)
    for _ in range(iterations):
        average = (np.bincount(place, w * now(s, m), target.size) / total).reshape(target.shape)
        now = CorrelationFunction(r, mu, now.xi * np.where(average != 0, target / np.where(average != 0, average, 1), 1))
    return now
