"""Triangles: counts and the three-point term of the isotropic three-point function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galacov.functions import geometry
from galacov.operators import blocks
from galacov.operators import pairs as pairing


def triangles(points: DataFrame, bins: pairing.Bins) -> DataFrame:
    """i < j < k with weights and sides, all sides inside the radial bins' range: the pair table joined to itself at i,
    closed by an equi-join on (j, k)."""
    p = pairing.pairs(points, points, bins.r_max, bins.r_min, same=True, ordered=False)
    p = p.select(F.col("id1").alias("i"), F.col("id2").alias("j"), F.col("w1").alias("wi"), F.col("w2").alias("wj"), F.col("s").alias("ij"))
    q = p.select("i", F.col("j").alias("k"), F.col("wj").alias("wk"), F.col("ij").alias("ik"))
    closing = p.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("ij").alias("jk"))
    return p.join(q, "i").where("j < k").join(closing, ["j", "k"])


def in_bins(bins: pairing.Bins) -> Column:
    """Of a triangle with sides ij, ik, jk: its corners (r1, r2, mu_bin), r1 <= r2 the bins of the sides that meet and mu_bin
    that of the angle's cosine over [-1, 1]; corners outside the bins are left out."""
    def corner(a: str, b: str, opposite: str) -> Column:
        x1, x2 = geometry.radial_bin(F.col(a), bins.edges), geometry.radial_bin(F.col(b), bins.edges)
        cosine = F.greatest(F.least(geometry.triangle_cosine(F.col(opposite), F.col(a), F.col(b)), F.lit(1.0)), F.lit(-1.0))
        mu = geometry.uniform_bin(cosine, bins.mu_low, bins.mu_high, bins.n_mu)
        return F.when(x1.isNotNull() & x2.isNotNull() & mu.isNotNull(), F.struct(F.least(x1, x2).alias("r1"), F.greatest(x1, x2).alias("r2"), mu.alias("mu_bin")))

    return F.array_compact(F.array(corner("ij", "ik", "jk"), corner("ij", "jk", "ik"), corner("ik", "jk", "ij")))


def corners(found: DataFrame, bins: pairing.Bins) -> DataFrame:
    """Each triangle up to three times, with r1, r2 and mu_bin of a corner."""
    out = found.withColumn("t", F.explode(in_bins(bins)))
    return out.withColumns({c: F.col(f"t.{c}") for c in ("r1", "r2", "mu_bin")}).drop("t")


@dataclass
class Corners:
    """Sums over triangles for blocks.over_leaves: by corner (r1, r2, mu_bin) of twice the weights' product, or, with xi, by two
    corners of w_i^2 w_j^2 w_k^2 x 9 (1 + xi_ij + xi_ik + xi_jk). Each triangle comes once, from its point of lowest rank."""

    bins: pairing.Bins
    xi: Callable | None = None

    def begin(self, a, b) -> dict:
        return {}

    def corner(self, x1: np.ndarray, x2: np.ndarray, a: np.ndarray, b: np.ndarray, opposite: np.ndarray) -> np.ndarray:
        """(r1 x bins + r2) x n_mu + mu_bin or -1; x1, x2: radial bins of the sides a, b."""
        n, bins = len(self.bins.edges), self.bins
        cosine = np.clip((a * a + b * b - opposite * opposite) / (2 * a * b), -1.0, 1.0)
        mu = np.minimum(np.floor((cosine - bins.mu_low) / ((bins.mu_high - bins.mu_low) / bins.n_mu)), bins.n_mu - 1).astype(np.int64)
        ok = (x1 >= 0) & (x2 >= 0) & (cosine >= bins.mu_low) & (cosine <= bins.mu_high)
        return np.where(ok, (np.minimum(x1, x2) * n + np.maximum(x1, x2)) * bins.n_mu + mu, -1)

    def put(self, state: dict, code: np.ndarray, value: np.ndarray, size: int) -> None:
        """Adds up by code; dense where there are few codes."""
        ok = code >= 0
        if not ok.all():
            code, value = code[ok], value[ok]
        if size <= 1 << 20:
            if "n" not in state:
                state["n"], state["v"] = np.zeros(size, np.int64), np.zeros(size)
            state["n"] += np.bincount(code, minlength=size)
            state["v"] += np.bincount(code, value, size)
            return
        keys, at = np.unique(code, return_inverse=True)
        for k, n, v in zip(keys.tolist(), np.bincount(at).tolist(), np.bincount(at, value).tolist(), strict=True):
            old = state.get(k, (0, 0.0))
            state[k] = (old[0] + n, old[1] + v)

    def add(self, state: dict, a, b, k: int) -> None:
        rows = np.arange(a.start[k], a.start[k + 1])
        others = a.near(a.low[k], a.high[k], self.bins.r_max, int(a.rank[rows].min()))
        found = [(i, j, s) for i, j, s, _ in blocks.met(a, rows, a, others, self.bins.r_max, self.bins.r_min, once=True)]
        if not found:
            return
        i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(i, kind="stable")
        i, j, s = i[order], j[order], s[order]
        ends = np.searchsorted(i, np.append(rows, rows[-1] + 1))
        for own, lo, hi in zip(rows, ends, ends[1:], strict=False):
            step = max(1, blocks.SOME // max(1, hi - lo))
            for at in range(lo, hi, step):  # the second point from a piece, the third from all after it
                self.around(state, a, own, j, s, at, min(at + step, hi), hi)

    def around(self, state: dict, a, own: int, js: np.ndarray, ss: np.ndarray, lo: int, mid: int, hi: int) -> None:
        j, k = js[lo:mid], js[lo:hi]
        d = blocks.differences(a, j, a, k)
        s2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        p, q = np.divmod(np.flatnonzero((s2 > 0) & (s2 < self.bins.r_max**2 * (1 + 1e-12)) & (np.arange(mid - lo)[:, None] < np.arange(hi - lo)[None])), hi - lo)
        jk = np.sqrt(s2[p, q])
        ok = (jk >= self.bins.r_min) & (jk < self.bins.r_max) & (a.id[j[p]] != a.id[k[q]])
        p, q, jk = p[ok], q[ok], jk[ok]
        if not len(p):
            return
        near = blocks.radial_bins(self.bins.edges, ss[lo:hi])
        ij, ik, x, y, z = ss[lo + p], ss[lo + q], near[p], near[q], blocks.radial_bins(self.bins.edges, jk)
        codes = [self.corner(x, y, ij, ik, jk), self.corner(x, z, ij, jk, ik), self.corner(y, z, ik, jk, ij)]
        wi, wj, wk = a.w[own], a.w[j[p]], a.w[k[q]]
        size = len(self.bins.edges) ** 2 * self.bins.n_mu
        if self.xi is None:
            v = 2 * wi * wj * wk
            for c in codes:
                self.put(state, c, v, size)
            return
        v = wi * wi * wj * wj * wk * wk * (9 * (self.xi(ij, 0.0) + self.xi(ik, 0.0) + self.xi(jk, 0.0)) + 9)
        for one in codes:
            for two in codes:
                self.put(state, np.where((one >= 0) & (two >= 0), one * size + two, -1), v, size * size)

    def rows(self, state: dict, a, b) -> list:
        if "n" in state:
            code = np.flatnonzero(state["n"])
            n, v = state["n"][code], state["v"][code]
        else:
            code = np.array(list(state), np.int64)
            n, v = (np.array([x[m] for x in state.values()], t) for m, t in ((0, np.int64), (1, float)))
        many, size = len(self.bins.edges), len(self.bins.edges) ** 2 * self.bins.n_mu
        place = lambda c: [c // self.bins.n_mu // many, c // self.bins.n_mu % many, c % self.bins.n_mu]
        return [*(place(code) if self.xi is None else place(code // size) + place(code % size)), n, v]


def counts(points: DataFrame, bins: pairing.Bins) -> DataFrame:
    """r1, r2, mu_bin, n, rrr: twice the weights' product at each corner of each triangle. Triangles stay in their task."""
    got = blocks.over_leaves(points, None, bins.r_max, Corners(bins), "r1 int, r2 int, mu_bin int, n long, rrr double")
    return got.groupBy("r1", "r2", "mu_bin").agg(F.sum("n").alias("n"), F.sum("rrr").alias("rrr"))


def three_point_term(points: DataFrame, bins: pairing.Bins, xi: Callable) -> DataFrame:
    """Sums over triangles of w_i^2 w_j^2 w_k^2 x 9 (1 + xi_ij + xi_ik + xi_jk) by the bins of two of its corners. xi: of arrays."""
    keys = ("r1", "r2", "mu_a", "r3", "r4", "mu_b")
    got = blocks.over_leaves(points, None, bins.r_max, Corners(bins, xi), ", ".join([f"{k} int" for k in keys] + ["n long", "value double"]))
    return got.groupBy(*keys).agg(F.sum("value").alias("value"))


def corrected_moments(rrr: DataFrame, model: DataFrame, n_mu: int, max_l: int) -> DataFrame:
    """r1, r2, l, coef: Legendre moments over the cosine of the symmetrised counts over the model's."""
    both = rrr.select("r1", "r2", "mu_bin", "rrr").unionByName(rrr.where("r1 != r2").select(F.col("r2").alias("r1"), F.col("r1").alias("r2"), "mu_bin", "rrr"))
    met = both.join(F.broadcast(model), ["r1", "r2", "mu_bin"]).withColumn("ratio", F.col("rrr") / F.col("model"))
    lo = F.lit(-1.0) + F.col("mu_bin") * F.lit(2.0 / n_mu)
    hi = lo + F.lit(2.0 / n_mu)
    parts = F.array(*[F.struct(F.lit(l).alias("l"), (geometry.legendre_integral(l, lo, hi) * (2 * l + 1) / 2).alias("f")) for l in range(max_l + 1)])
    return met.withColumn("x", F.explode(parts)).groupBy("r1", "r2", F.col("x.l").alias("l")).agg(F.sum(F.col("ratio") * F.col("x.f")).alias("coef"))


def inverse_correction(cosine: Column, coef: Column) -> Column:
    """1 / Phi = sum_l coef_l P_l."""
    return sum((coef[l] * geometry.legendre(l, cosine) for l in range(1, 7)), coef[0])


def images(terms: DataFrame, n_r: int, n_l: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, row, col, value) averaged over the eight places that stand for the same sum: the two radial bins of either
    triangle swapped, and rows with columns. row = (r1 x n_r + r2) x n_l + l."""
    def swapped(c: str) -> Column:
        pair, l = F.expr(f"{c} div {n_l}"), F.col(c) % n_l
        return ((pair % n_r * n_r + F.expr(f"({c} div {n_l}) div {n_r}")) * n_l + l).cast("int")

    sides = F.array(*[F.struct(r.alias("row"), c.alias("col")) for r in (F.col("row").cast("int"), swapped("row")) for c in (F.col("col").cast("int"), swapped("col"))])
    both = F.concat(sides, F.transform(sides, lambda p: F.struct(p["col"].alias("row"), p["row"].alias("col"))))
    each = terms.select(*keys, F.explode(both).alias("p"), "value")
    return each.groupBy(*keys, F.col("p.row").alias("row"), F.col("p.col").alias("col")).agg((F.sum("value") / 8).alias("value"))


def combined(terms: DataFrame, alpha: float, n_r: int, n_l: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """C6 + alpha C5 + alpha^2 C4 + alpha^3 C3 of (term, topology, row, col, value): C3 to C5 from both topologies, C6 from
    the second only; averaged over all images."""
    power = F.when(F.col("term") == "c6", F.when(F.col("topology") == 1, 1.0).otherwise(0.0)).when(F.col("term") == "c5", float(alpha)).when(F.col("term") == "c4", float(alpha) ** 2).when(F.col("term") == "c3", float(alpha) ** 3)
    return images(terms.groupBy(*keys, "row", "col").agg(F.sum(F.col("value") * power).alias("value")), n_r, n_l, keys)
