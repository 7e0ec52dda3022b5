"""Counts, weights and covariances by resampling region. One grouped pass serves all regions; nothing loops over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galacov.operators import blocks
from galacov.operators import pairs as pairing


def counts(found: DataFrame) -> DataFrame:
    """jack, r_bin, mu_bin, value from binned pairs with jack1, jack2, w1, w2: a pair gives half to either region."""
    half = F.col("w1") * F.col("w2") * 0.5
    each = found.select("r_bin", "mu_bin", half.alias("v"), F.explode(F.array("jack1", "jack2")).alias("jack"))
    return each.groupBy("jack", "r_bin", "mu_bin").agg(F.sum("v").alias("value"))


def by_region(left: DataFrame, right: DataFrame | None, bins: pairing.Bins, box: float | None) -> DataFrame:
    """jack, r_bin, mu_bin, value from pairs that are met once."""
    n = len(bins.edges) * bins.n_mu

    def each(a, i, b, j, s, mu):
        at, v = (blocks.flat_bins(bins, s, mu), n), a.w[i] * b.w[j] * 0.5
        return [([blocks.region("jack", a, b, c, p), at], [v]) for c, p in ((a, i), (b, j))]

    found = blocks.pair_sums(left, right, bins.r_max, bins.r_min, each, ["jack", "bin"], ["value"], box, ("w", "jack"), {"jack": "jack"})
    return pairing.unflat(found, bins.n_mu).select("jack", "r_bin", "mu_bin", "value")


def pair_counts(points: DataFrame, bins: pairing.Bins, box: float | None = None) -> DataFrame:
    """Of ordered pairs of one table with a column jack."""
    return by_region(points, None, bins, box).withColumn("value", F.col("value") * 2)


def cross_counts(left: DataFrame, right: DataFrame, bins: pairing.Bins, box: float | None = None) -> DataFrame:
    return by_region(left, right, bins, box)


def weights(table: DataFrame) -> DataFrame:
    """jack, r_bin, mu_bin, weight: a region's share of each bin's pairs."""
    total = table.groupBy("r_bin", "mu_bin").agg(F.sum("value").alias("total"))
    return table.join(total, ["r_bin", "mu_bin"]).select("jack", "r_bin", "mu_bin", F.when(F.col("total") != 0, F.col("value") / F.col("total")).alias("weight"))


def product_weights(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """bin_a, bin_b, value: sum over regions of w_aA w_bA, for weights keyed by (jack, bin, weight)."""
    a = left.select("jack", F.col("bin").alias("bin_a"), F.col("weight").alias("wa"))
    b = (right if right is not None else left).select("jack", F.col("bin").alias("bin_b"), F.col("weight").alias("wb"))
    return a.join(b, "jack").groupBy("bin_a", "bin_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("value"))


def flat(table: DataFrame, n_mu: int) -> DataFrame:
    """bin = r_bin x n_mu + mu_bin."""
    return table.withColumn("bin", (F.col("r_bin") * n_mu + F.col("mu_bin")).cast("int"))


def landy_szalay(dd: DataFrame, dr: DataFrame, rd: DataFrame, rr: DataFrame, sums: DataFrame) -> DataFrame:
    """xi of each region from its counts (jack, r_bin, mu_bin, value) and its sums of weights (jack, data, random): the
    pairs of a region's points with all, normalised by sums over the whole; DR is the mean of both orders."""
    key = ["jack", "r_bin", "mu_bin"]
    out = rr.select(*key, F.col("value").alias("rr"))
    for name, t in (("dd", dd), ("dr", dr), ("rd", rd)):
        out = out.join(t.select(*key, F.col("value").alias(name)), key, "left")
    totals = sums.agg(F.sum("data").alias("d"), F.sum("random").alias("r"))
    out = out.fillna(0.0, ["dd", "dr", "rd"]).crossJoin(F.broadcast(totals))
    both = (F.col("dr") + F.col("rd")) / 2 / (F.col("d") * F.col("r"))
    one, ran = F.col("dd") / (F.col("d") * F.col("d")), F.col("rr") / (F.col("r") * F.col("r"))
    return out.select(*key, F.when(ran != 0, (one - 2 * both + ran) / ran).alias("xi"))


def data_covariance(xi: DataFrame, weight: DataFrame) -> DataFrame:
    """bin_a, bin_b, value: sum_A w_aA w_bA (xi_aA - mean_a)(xi_bA - mean_b) / (1 - sum_A w_aA w_bA) over the regions
    whose xi is finite in all bins, with weights normalised over these."""
    both = xi.join(weight, ["jack", "bin"])
    bad = xi.where(F.col("xi").isNull() | F.isnan("xi") | (F.abs("xi") == float("inf"))).select("jack").distinct()
    both = both.join(F.broadcast(bad), "jack", "left_anti")  # as many rows as regions
    total = both.groupBy("bin").agg(F.sum("weight").alias("tw"), F.sum(F.col("weight") * F.col("xi")).alias("twx"))
    own = both.join(total, "bin").select("jack", "bin", (F.col("weight") / F.col("tw")).alias("w"), (F.col("xi") - F.col("twx") / F.col("tw")).alias("d"))
    a = own.select("jack", F.col("bin").alias("bin_a"), F.col("w").alias("wa"), F.col("d").alias("da"))
    b = own.select("jack", F.col("bin").alias("bin_b"), F.col("w").alias("wb"), F.col("d").alias("db"))
    met = a.join(b, "jack").withColumn("p", F.col("wa") * F.col("wb"))
    sums = met.groupBy("bin_a", "bin_b").agg(F.sum(F.col("p") * F.col("da") * F.col("db")).alias("c"), F.sum("p").alias("p"))
    return sums.select("bin_a", "bin_b", (F.col("c") / (1 - F.col("p"))).alias("value"))


def half_counts(points: DataFrame, bins: pairing.Bins, xi, arrays: bool = False) -> DataFrame:
    """half, jack, bin, rr, ee from pairs whose points fall into the same half: sums of w w and of w w xi, half to each
    point's region. Pairs of one half are a quarter of all. arrays: xi is a function of arrays, and no pair leaves its task;
    otherwise of columns."""
    if arrays:
        n = len(bins.edges) * bins.n_mu

        def each(a, i, b, j, s, mu):
            half, many = blocks.region("half", a, b, a, i)
            half = np.where((half == b.half[j]) & (half < many - 1), half, -1)
            w = a.w[i] * b.w[j] * 0.5 / 0.25
            values, at = [w, w * xi(s, mu)], (blocks.flat_bins(bins, s, mu), n)
            return [([(half, many), blocks.region("jack", a, b, c, p), at], values) for c, p in ((a, i), (b, j))]

        found = blocks.pair_sums(points, None, bins.r_max, bins.r_min, each, ["half", "jack", "bin"], ["rr", "ee"], None, ("w", "jack", "half"), {"half": "half", "jack": "jack"})
        return found.select("half", "jack", "bin", (F.col("rr") * 2).alias("rr"), (F.col("ee") * 2).alias("ee"))
    met = pairing.pairs(points, points, bins.r_max, bins.r_min, carry=("w", "jack", "half"), same=True)
    met = pairing.binned(met, bins).where("half1 = half2")
    w = F.col("w1") * F.col("w2") * 0.5 / 0.25
    each = met.select("r_bin", "mu_bin", F.col("half1").alias("half"), w.alias("w"), (w * xi(F.col("s"), F.col("mu"))).alias("e"), F.explode(F.array("jack1", "jack2")).alias("jack"))
    return flat(each, bins.n_mu).groupBy("half", "jack", "bin").agg(F.sum("w").alias("rr"), F.sum("e").alias("ee"))


def disconnected(halves: DataFrame, rr: DataFrame, products: DataFrame) -> DataFrame:
    """bin_a, bin_b, value: sum_A [EE1_aA - w1_aA EE1_a][EE2_bA - w2_bA EE2_b] / (RR_a RR_b (1 - sum_A w_aA w_bA)), with
    w1 = RR1_aA / RR1_a. halves: half_counts; rr: (bin, rr); products: product_weights."""
    total = halves.groupBy("half", "bin").agg(F.sum("rr").alias("trr"), F.sum("ee").alias("tee"))
    own = halves.join(total, ["half", "bin"]).select("half", "jack", "bin", (F.col("ee") - F.when(F.col("trr") != 0, F.col("rr") / F.col("trr")).otherwise(0.0) * F.col("tee")).alias("d"))
    a = own.where("half = 0").select("jack", F.col("bin").alias("bin_a"), F.col("d").alias("da"))
    b = own.where("half = 1").select("jack", F.col("bin").alias("bin_b"), F.col("d").alias("db"))
    sums = a.join(b, "jack").groupBy("bin_a", "bin_b").agg(F.sum(F.col("da") * F.col("db")).alias("c"))
    out = sums.join(products.select("bin_a", "bin_b", F.col("value").alias("p")), ["bin_a", "bin_b"])
    out = out.join(rr.select(F.col("bin").alias("bin_a"), F.col("rr").alias("ra")), "bin_a").join(rr.select(F.col("bin").alias("bin_b"), F.col("rr").alias("rb")), "bin_b")
    return out.select("bin_a", "bin_b", (F.col("c") / (F.col("ra") * F.col("rb") * (1 - F.col("p")))).alias("value"))
