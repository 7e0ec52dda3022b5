"""Pairs within a distance, counts in (s, µ) bins and correlation functions.

Counts are added up by operators.blocks. Where the pairs themselves are wanted, the distance condition becomes an equi-join on cells: cells are as wide as the largest distance, one side is copied into
its 27 neighbour cells (14 where each pair is wanted once), and the exact condition is checked on what meets. A cell that is too full for one task is a
skewed key of a sort-merge join, which Spark splits. The copies carry only id, position, weight and labels.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galacov.functions import geometry
from galacov.operators import blocks, catalog


@dataclass(frozen=True)
class Bins:
    """Radial intervals [low, high) and linear bins of µ."""

    edges: tuple[tuple[float, float], ...]
    n_mu: int = 1
    mu_low: float = 0.0
    mu_high: float = 1.0

    @property
    def r_max(self) -> float:
        return max(hi for _, hi in self.edges)

    @property
    def r_min(self) -> float:
        return min(lo for lo, _ in self.edges)

    def grid(self, spark) -> DataFrame:
        """r_bin, mu_bin of every bin."""
        return spark.range(len(self.edges) * self.n_mu).select(
            F.expr(f"cast(id div {self.n_mu} as int)").alias("r_bin"), (F.col("id") % self.n_mu).cast("int").alias("mu_bin"))


STEPS = tuple((a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))


def neighbours(points: DataFrame, periodic: int | None = None, half: bool = False) -> DataFrame:
    """Each point once for each of the 27 cells around its own, or for its own and 13 that make up one of each two
    opposite ones (half); home tells its own. With fewer than three periodic cells, each distinct cell once."""
    chosen = [s for s in STEPS if not half or s >= (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("abc", s, strict=True)]) for s in chosen])
    home = F.expr("__n.a = 0 and __n.b = 0 and __n.c = 0")
    if periodic and periodic < 3:
        around = F.array_distinct(F.transform(steps, lambda s: F.struct(*[F.pmod(F.col(f"c{c}") + s[k], F.lit(periodic)).alias(k) for c, k in zip("xyz", "abc", strict=True)])))
        return points.withColumn("__n", F.explode(around)).withColumns({f"c{c}": F.col(f"__n.{k}") for c, k in zip("xyz", "abc", strict=True)}).withColumn("home", F.lit(False)).drop("__n")
    out = points.withColumn("__n", F.explode(steps)).withColumn("home", home)
    moved = {f"c{c}": F.col(f"c{c}") + F.col(f"__n.{k}") for c, k in zip("xyz", "abc", strict=True)}
    if periodic:
        moved = {c: F.pmod(x, F.lit(periodic)) for c, x in moved.items()}
    return out.withColumns(moved).drop("__n")


def pairs(left: DataFrame, right: DataFrame, r_max: float, r_min: float = 0.0, box: float | None = None, carry: Sequence[str] = ("w",),
          same: bool = False, ordered: bool = True) -> DataFrame:
    """id1, id2, s, mu and the carried columns of both (w1, w2, ...) of all pairs with r_min <= s < r_max and s > 0.

    same: both sides are one table, a point is no pair with itself, and with ordered=False each pair comes once, the
    smaller id first: then half the neighbour cells do."""
    whole = int(box // r_max) if box else None
    if box and not whole:
        raise ValueError("the box is smaller than the largest distance")
    cell = box / whole if box else r_max
    cols = ["id", "x", "y", "z", *carry]
    half = same and not ordered and not (whole and whole < 3)
    a = neighbours(catalog.cells(left.select(*cols), cell, periodic=whole), whole, half)
    b = catalog.cells(right.select(*cols), cell, periodic=whole)
    a = a.select("cx", "cy", "cz", "home", *[F.col(c).alias(f"{c}1") for c in cols])
    b = b.select("cx", "cy", "cz", *[F.col(c).alias(f"{c}2") for c in cols])
    met = a.join(b, ["cx", "cy", "cz"])
    if half:
        met = met.where("id1 < id2 or (id1 > id2 and not home)")
    elif same:
        met = met.where("id1 != id2" if ordered else "id1 < id2")
    d = [F.col(f"{c}1") - F.col(f"{c}2") for c in "xyz"]
    if box:
        d = [geometry.minimum_image(x, box) for x in d]
    met = met.withColumn("s2", geometry.square(d[0]) + geometry.square(d[1]) + geometry.square(d[2])).where(
        (F.col("s2") > 0) & (F.col("s2") < F.lit(float(r_max) ** 2 * (1 + 1e-12))))
    met = met.withColumn("s", F.sqrt("s2")).where((F.col("s") >= r_min) & (F.col("s") < r_max))
    if box:
        mu = geometry.mu_along_z(d[2], F.col("s"))
    else:
        mu = geometry.mu_to_observer([F.col(f"{c}1") for c in "xyz"], [F.col(f"{c}2") for c in "xyz"])
    out = met.select("id1", "id2", "s", mu.alias("mu"), *[f"{c}{k}" for c in carry for k in (1, 2)])
    if not half:
        return out
    turned = F.col("id1") > F.col("id2")
    side = lambda c, k: F.when(turned, F.col(f"{c}{3 - k}")).otherwise(F.col(f"{c}{k}")).alias(f"{c}{k}")
    return out.select(side("id", 1), side("id", 2), "s", "mu", *[side(c, k) for c in carry for k in (1, 2)])


def binned(found: DataFrame, bins: Bins) -> DataFrame:
    """With r_bin and mu_bin, only pairs that have both."""
    mu = F.lit(0.5) if bins.n_mu == 1 and bins.mu_low == 0 and bins.mu_high == 1 else F.col("mu")
    out = found.withColumn("r_bin", geometry.radial_bin(F.col("s"), bins.edges)).withColumn("mu_bin", geometry.uniform_bin(mu, bins.mu_low, bins.mu_high, bins.n_mu))
    return out.where("r_bin is not null and mu_bin is not null")


def count(left: DataFrame, right: DataFrame | None, bins: Bins, box: float | None = None, value: str = "wpairs") -> DataFrame:
    """r_bin, mu_bin, npairs, and the sum of products of weights, for every bin; of ordered pairs of one table, or of
    pairs between two. Pairs of one table are met once and counted twice; none leaves its task."""
    times, n = 2 if right is None else 1, len(bins.edges) * bins.n_mu
    each = lambda a, i, b, j, s, mu: [([(blocks.flat_bins(bins, s, mu), n)], [a.w[i] * b.w[j]])]
    found = blocks.pair_sums(left, right, bins.r_max, bins.r_min, each, ["bin"], ["v"], box)
    found = unflat(found, bins.n_mu).select("r_bin", "mu_bin", (F.col("n") * times).alias("npairs"), (F.col("v") * times).alias(value))
    full = bins.grid(left.sparkSession).join(F.broadcast(found), ["r_bin", "mu_bin"], "left")  # as many rows as bins
    return full.select("r_bin", "mu_bin", F.coalesce("npairs", F.lit(0)).alias("npairs"), F.coalesce(value, F.lit(0.0)).alias(value))


def unflat(table: DataFrame, n_mu: int) -> DataFrame:
    """r_bin and mu_bin from bin = r_bin x n_mu + mu_bin."""
    return table.withColumn("r_bin", F.expr(f"cast(bin div {n_mu} as int)")).withColumn("mu_bin", (F.col("bin") % n_mu).cast("int"))


def analytic_rr(spark, bins: Bins, weight: float, box: float) -> DataFrame:
    """Expected pair weight in a periodic box: (sum of weights)^2 x shell volume / box volume / bins of µ."""
    out = bins.grid(spark)
    table = F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in bins.edges])
    edge = F.element_at(table, F.col("r_bin") + 1)
    value = geometry.shell_volume(edge["lo"], edge["hi"]) * F.lit(float(weight) ** 2 / float(box) ** 3 / bins.n_mu)
    return out.select("r_bin", "mu_bin", value.alias("rr"))


def normalisers(table: DataFrame) -> DataFrame:
    """One row: the sum of weights."""
    return table.agg(F.sum("w").alias("total"))


def landy_szalay(dd: DataFrame, dr: DataFrame, rr: DataFrame, data_sum: float, random_sum: float, rd: DataFrame | None = None, data2_sum: float | None = None,
                 random2_sum: float | None = None) -> DataFrame:
    """(DD - DR - RD + RR) / RR of normalised weighted counts; RD is DR for one tracer."""
    d2, r2 = data2_sum or data_sum, random2_sum or random_sum
    key = ["r_bin", "mu_bin"]
    out = dd.select(*key, (F.col("wpairs") / F.lit(data_sum * d2)).alias("dd"))
    out = out.join(dr.select(*key, (F.col("wpairs") / F.lit(data_sum * r2)).alias("dr")), key)
    other = (rd if rd is not None else dr).select(*key, (F.col("wpairs") / F.lit(random_sum * d2 if rd is not None else data_sum * r2)).alias("rd"))
    out = out.join(other, key).join(rr.select(*key, (F.col("wpairs") / F.lit(random_sum * r2)).alias("rr")), key)
    return out.withColumn("xi", F.when(F.col("rr") != 0, (F.col("dd") - F.col("dr") - F.col("rd") + F.col("rr")) / F.col("rr")))


def natural(dd: DataFrame, rr: DataFrame, data_sum: float, random_sum: float) -> DataFrame:
    """DD / RR - 1 of normalised counts."""
    out = dd.select("r_bin", "mu_bin", (F.col("wpairs") / F.lit(data_sum**2)).alias("dd")).join(
        rr.select("r_bin", "mu_bin", (F.col("rr") / F.lit(random_sum**2)).alias("rr")), ["r_bin", "mu_bin"])
    return out.withColumn("xi", F.when(F.col("rr") != 0, F.col("dd") / F.col("rr") - 1))


def post_reconstruction(xi: DataFrame, rr: DataFrame, ss: DataFrame) -> DataFrame:
    """The input correlation function of a reconstructed catalog: xi x RR / SS."""
    key = ["r_bin", "mu_bin"]
    out = xi.select(*key, "xi").join(rr.select(*key, F.col("wpairs").alias("rr")), key).join(ss.select(*key, F.col("wpairs").alias("ss")), key)
    return out.select(*key, F.when(F.col("ss") != 0, F.col("xi") * F.col("rr") / F.col("ss")).alias("xi"))


def scaled_counts(counts: DataFrame, factor: float, split: float | None, s: str = "s") -> DataFrame:
    """Counts over a factor, and over its square below the split separation."""
    f = F.lit(float(factor))
    value = F.col("rr") / f if split is None else F.when(F.col(s) < split, F.col("rr") / f / f).otherwise(F.col("rr") / f)
    return counts.withColumn("rr", value)


def rebinned(counts: DataFrame, r_factor: int, mu_factor: int, values: Sequence[str]) -> DataFrame:
    """Sums over blocks of bins."""
    r, mu = F.expr(f"cast(r_bin div {r_factor} as int)"), F.expr(f"cast(mu_bin div {mu_factor} as int)")
    return counts.groupBy(r.alias("r_bin"), mu.alias("mu_bin")).agg(*[F.sum(v).alias(v) for v in values])


def wrapped(counts: DataFrame, n_mu: int, values: Sequence[str]) -> DataFrame:
    """Bins of µ from -1 to 1 folded onto 0 to 1: bin i and its reflection add up."""
    half = n_mu // 2
    folded = F.when(F.col("mu_bin") >= half, F.col("mu_bin") - half).otherwise(half - 1 - F.col("mu_bin")).cast("int")
    return counts.groupBy("r_bin", folded.alias("mu_bin")).agg(*[F.sum(v).alias(v) for v in values])


def mirror_fixed(counts: DataFrame, n_mu: int, value: str) -> DataFrame:
    """A negative count takes the value of its reflection in µ."""
    other = counts.select("r_bin", (F.lit(n_mu - 1) - F.col("mu_bin")).alias("mu_bin"), F.col(value).alias("__mirror"))
    out = counts.join(other, ["r_bin", "mu_bin"], "left")
    return out.withColumn(value, F.when((F.col(value) < 0) & (F.col("__mirror") >= 0), F.col("__mirror")).otherwise(F.col(value))).drop("__mirror")


def cut(counts: DataFrame, skip_first: int = 0, skip_last: int = 0, n_r: int | None = None) -> DataFrame:
    """Without the first and last radial bins; bins are numbered anew."""
    last = (n_r or 1 << 30) - skip_last
    return counts.where((F.col("r_bin") >= skip_first) & (F.col("r_bin") < last)).withColumn("r_bin", (F.col("r_bin") - skip_first).cast("int"))


def summed(estimates: DataFrame, values: Sequence[str]) -> DataFrame:
    """Counts of several estimates (mocks) added by bin."""
    return estimates.groupBy("r_bin", "mu_bin").agg(*[F.sum(v).alias(v) for v in values])


