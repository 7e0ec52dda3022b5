"""The exact 2-, 3- and 4-point terms by leaves of points (operators.blocks): matrix products instead of rows of tuples.

The sum over three points is, around each middle point j, a product leg(j, i) x link(i, k) x leg(k, j). That over four is
T(j, k) R(j, k) summed over pairs j, k, with T the sum over i of leg(j, i) link(i, k) and R that over l of link(j, l) leg(l, k);
the tuples in which i is l are a sum over single points and are taken off. A leg holds one column for each bin, moment or
shell. Jackknife weights are sums of functions of one or two regions, so that sums by region and over equal regions are all
they need. Ids are unique.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galacov.operators import blocks
from galacov.operators.blocks import SOME, Cloud


# ---- legs ------------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Leg:
    """place(s, mu) -> (group of each pair or -1, factors [n, pairs] or None for one factor of 1). A column is group x n
    + the factor's number."""

    r_max: float
    r_min: float
    groups: int
    n: int
    place: Callable

    @property
    def width(self) -> int:
        return self.groups * self.n


def binned(bins) -> Leg:
    return Leg(bins.r_max, bins.r_min, len(bins.edges) * bins.n_mu, 1, lambda s, mu: (blocks.flat_bins(bins, s, mu), None))


def legendre(l: int, x: np.ndarray) -> np.ndarray:
    from galacov.functions.geometry import legendre_coefficients

    out = np.zeros_like(x)
    for c in reversed(legendre_coefficients(l)):
        out = out * x + c
    return out


def accumulated(bins, max_l: int, phi: Callable, volumes: Sequence[float]) -> Leg:
    """Groups are radial bins, factors Phi P_l(mu) (2l + 1) / V. phi: of the radial bin and mu, as arrays."""
    ls = range(0, max_l + 1, 2)

    def place(s, mu):
        r = np.where(blocks.flat_bins(bins, s, mu) >= 0, blocks.radial_bins(bins.edges, s), -1)
        f = phi(r, mu) / np.asarray(volumes)[np.maximum(r, 0)]
        return r, np.stack([f * legendre(l, mu) * (2 * l + 1) for l in ls])

    return Leg(bins.r_max, bins.r_min, len(bins.edges), len(ls), place)


def windowed(bins, factors: Callable, n: int) -> Leg:
    """One group; factors(s, mu) -> (inside, [n, pairs])."""
    def place(s, mu):
        inside, f = factors(s, mu)
        return np.where(inside & (blocks.flat_bins(bins, s, mu) >= 0), 0, -1), f

    return Leg(bins.r_max, bins.r_min, 1, n, place)


# ---- two points ------------------------------------------------------------------------------------------------------
def two(points: DataFrame, leg: Leg, xi: Callable, regions: bool = False) -> DataFrame:
    """g (the group), v0, v1, ... (n x n of them): 2 sum w_i^2 w_j^2 (1 + xi) f_p f_q over ordered pairs; with regions also
    jack_i and jack_j, of pairs taken once."""
    def each(a, i, b, j, s, mu):
        g, f = leg.place(s, mu)
        v = 2 * a.w[i] * a.w[i] * b.w[j] * b.w[j] * (1 + xi(s, mu)) * 2
        values = [v] if f is None else [v * f[p] * f[q] for p in range(leg.n) for q in range(leg.n)]
        own = [blocks.region("jack", a, b, c, k) for c, k in ((a, i), (b, j))] if regions else []
        return [([(g, leg.groups), *own], values)]

    keys, carry = (["g", "jack_i", "jack_j"], ("w", "jack")) if regions else (["g"], ("w",))
    return blocks.pair_sums(points, None, leg.r_max, leg.r_min, each, keys, [f"v{k}" for k in range(leg.n**2)], None, carry, {"jack_i": "jack", "jack_j": "jack"} if regions else None)


def spread(got: DataFrame, n: int) -> DataFrame:
    """a, b, value from the values v0, v1, ... by group of two()."""
    cells = F.array(*[F.struct((F.col("g") * n + p).alias("a"), (F.col("g") * n + q).alias("b"), F.col(f"v{p * n + q}").alias("value")) for p in range(n) for q in range(n)])
    return got.select(F.explode(cells).alias("c")).select("c.a", "c.b", "c.value")


def moments(got: DataFrame, max_l: int) -> DataFrame:
    """r_a, p, r_b, q, value of sums by the columns of accumulated()."""
    n = max_l // 2 + 1
    bin_, l = (lambda c: F.expr(f"cast({c} div {n} as int)")), (lambda c: (F.col(c) % n * 2).cast("int"))
    return got.select(bin_("a").alias("r_a"), l("a").alias("p"), bin_("b").alias("r_b"), l("b").alias("q"), "value")


# ---- three and four points -------------------------------------------------------------------------------------------
TOTAL, FIRST, SECOND, MIDDLE, LINKED = range(5)
ROWS = "kind int, a int, b int, jack int, n long, value double"


@dataclass
class Sums:
    """Sums over triples or quadruples as blocks.over_leaves takes them. Rows: TOTAL by both columns, n = 1 where some tuple
    has both groups. With regions also FIRST, SECOND: by the region of j, of k; MIDDLE: over j and k of one region; LINKED:
    over i and k of one region."""

    leg: Leg
    cut: float
    xi: Callable
    four: bool
    isotropic: bool = False
    regions: bool = False

    def begin(self, a: Cloud, b: Cloud) -> dict:
        w, many = self.leg.width, len(a.jacks) + 1 if self.regions else 1
        return {"sum": np.zeros((5, many, w, w)), "seen": np.zeros((self.leg.groups,) * 2, bool), "slot": np.zeros(a.xyz.shape[1], np.int64)}

    # -- pieces
    def links(self, c: Cloud, i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x of pairs within the cutoff, 0 elsewhere; and which those are."""
        x, near = np.empty((len(i), len(k))), np.empty((len(i), len(k)), bool)
        step = max(1, SOME // max(1, len(k)))
        for at in range(0, len(i), step):
            rows = i[at : at + step]
            d = blocks.differences(c, rows, c, k)
            s2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
            s = np.sqrt(s2)
            hit = (s2 > 0) & (s < self.cut)
            with np.errstate(divide="ignore", invalid="ignore"):
                if self.isotropic:
                    x[at : at + step] = np.where(hit, self.xi(s, None), 0.0)
                else:
                    p, q = np.divmod(np.flatnonzero(hit), len(k))
                    v = np.zeros(hit.shape)
                    mu = blocks.cosines(c, rows[p], c, k[q], [y[p, q] for y in d], s[p, q])
                    v[p, q] = self.xi(s[p, q], mu)
                    x[at : at + step] = v
            near[at : at + step] = hit
        return x, near

    def legs(self, c: Cloud, rows: np.ndarray, others: np.ndarray, slot: np.ndarray):
        """[column, row, other] of leg factors times the other's weight, and (row, other, group, s, mu, factors) in pieces."""
        out, pieces = np.zeros((self.leg.width, len(rows), len(others))), []
        slot[others] = np.arange(len(others))
        for i, j, s, mu in blocks.met(c, rows, c, others, self.leg.r_max, self.leg.r_min):
            g, f = self.leg.place(s, mu)
            ok = g >= 0
            if not ok.all():
                i, j, s, mu, g, f = i[ok], j[ok], s[ok], mu[ok], g[ok], None if f is None else f[:, ok]
            p, q = i - rows[0], slot[j]
            for n in range(self.leg.n):
                out[g * self.leg.n + n, p, q] = c.w[j] if f is None else c.w[j] * f[n]
            pieces.append((p, q, g, s, mu, f))
        return out, pieces

    def marks(self, pieces: list, rows: int, others: int) -> np.ndarray:
        """[group, row, other]: 1 where there is a leg."""
        out = np.zeros((self.leg.groups, rows, others))
        for p, q, g, *_ in pieces:
            out[g, p, q] = 1
        return out

    @staticmethod
    def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), -1) @ y.reshape(len(y), -1).T

    def add(self, state: dict, a: Cloud, b: Cloud, k: int) -> None:
        (self.add_four if self.four else self.add_three)(state, a, k)

    # -- three
    def add_three(self, state: dict, c: Cloud, k: int) -> None:
        rows = np.arange(c.start[k], c.start[k + 1])
        others = c.near(c.low[k], c.high[k], self.leg.r_max)
        u, pieces = self.legs(c, rows, others, state["slot"])
        used = np.flatnonzero((u != 0).any(axis=(0, 1))) if c.valid[others].all() and (c.w[others] != 0).all() else np.arange(len(others))
        marks = None if state["seen"].all() else self.marks(pieces, len(rows), len(others))[:, :, used]
        u, others = np.ascontiguousarray(u[:, :, used]), others[used]
        width, m, n = u.shape
        if not n:
            return
        step = max(64, (SOME * 16) // n)
        for at in range(0, n, step):
            some = slice(at, at + step)
            x, near = self.links(c, others, others[some])
            t = (u.reshape(width * m, n) @ x).reshape(width, m, -1)
            if marks is not None and not state["seen"].all():
                there = (marks.reshape(-1, n) @ near).reshape(len(marks), m, -1) > 0
                state["seen"] |= self.product(there.astype(float), marks[:, :, some]) > 0
            linked = None
            if self.regions:
                same = (c.jack[others][:, None] == c.jack[others[some]][None]) & (c.jack[others] < len(c.jacks))[:, None]
                linked = (u.reshape(width * m, n) @ (x * same)).reshape(width, m, -1)
            w = (c.w[rows] ** 2)[:, None] * np.ones(t.shape[2])
            self.gather(state["sum"], c, rows, others[some], t, u[:, :, some], w, linked)

    def gather(self, out: np.ndarray, c: Cloud, rows: np.ndarray, others: np.ndarray, t: np.ndarray, r: np.ndarray, w: np.ndarray, linked: np.ndarray | None) -> None:
        """Adds the sums of w t_a r_b over rows j and others k."""
        tw = t * w
        if not self.regions:
            out[TOTAL, 0] += self.product(tw, r)
            return
        jj, jk, none = c.jack[rows], c.jack[others], len(c.jacks)
        out[TOTAL, none] += self.product(tw, r)
        for at in np.unique(jj):
            out[FIRST, at] += self.product(tw[:, jj == at], r[:, jj == at])
        for at in np.unique(jk):
            one = self.product(tw[:, :, jk == at], r[:, :, jk == at])
            out[SECOND, at] += one
            if at < none:
                out[MIDDLE, none] += self.product(tw[:, jj == at][:, :, jk == at], r[:, jj == at][:, :, jk == at])
        if linked is not None:
            out[LINKED, none] += self.product(linked * w, r)

    # -- four
    def add_four(self, state: dict, c: Cloud, k: int) -> None:
        rows = np.arange(c.start[k], c.start[k + 1])
        by_leg = c.near(c.low[k], c.high[k], self.leg.r_max)
        by_link = c.near(c.low[k], c.high[k], self.cut)
        u, pieces = self.legs(c, rows, by_leg, state["slot"])
        out, none = state["sum"], len(c.jacks) if self.regions else 0
        self.take_off(out, c, rows, by_leg, pieces)
        marks = None if state["seen"].all() else self.marks(pieces, len(rows), len(by_leg))
        far = c.gaps(c.low, c.high, c.low[k], c.high[k])
        first = c.rank[rows].min()
        for other in np.flatnonzero((far < (self.leg.r_max + self.cut) ** 2 * (1 + 1e-9)) & (c.last > first)):
            ks, box = np.arange(c.start[other], c.start[other + 1]), (c.low[other], c.high[other])
            i_in = c.within(by_leg, *box, self.cut)
            ls = by_link[c.within(by_link, *box, self.leg.r_max)]
            if not i_in.any() or not len(ls):
                continue
            ui, i = np.ascontiguousarray(u[:, :, i_in]), by_leg[i_in]
            x, near = self.links(c, i, ks)
            y, close = self.links(c, rows, ls)
            v, other_pieces = self.legs(c, ks, ls, state["slot"])
            width, m, n = self.leg.width, len(rows), len(ks)
            t = (ui.reshape(width * m, -1) @ x).reshape(width, m, n)
            r = (v.reshape(width * n, -1) @ y.T).reshape(width, n, m).transpose(0, 2, 1)
            w = c.w[rows][:, None] * c.w[ks][None]
            once = c.rank[rows][:, None] < c.rank[ks][None]
            if not once.all():
                w = w * once
            if marks is not None and not state["seen"].all():
                self.look(state["seen"], marks[:, :, i_in], i, near, self.marks(other_pieces, n, len(ls)), ls, close, once)
            # Each pair j, k comes once; the other order has T and R exchanged.
            if not self.regions:
                d = self.product(t * w, r)
                out[TOTAL, 0] += d + d.T
                continue
            one = np.zeros_like(out)
            jack, labels = c.jack, len(c.jacks)
            xe = x * ((jack[i][:, None] == jack[ks][None]) & (jack[i] < labels)[:, None])
            ye = y * ((jack[rows][:, None] == jack[ls][None]) & (jack[rows] < labels)[:, None])
            t2 = (ui.reshape(width * m, -1) @ xe).reshape(width, m, n)
            r2 = (v.reshape(width * n, -1) @ ye.T).reshape(width, n, m).transpose(0, 2, 1)
            self.gather(one, c, rows, ks, t, r, w, t2)
            turn = one.transpose(0, 1, 3, 2)
            out[TOTAL] += one[TOTAL] + turn[TOTAL]
            out[FIRST] += one[FIRST] + turn[SECOND]
            out[MIDDLE] += one[MIDDLE] + turn[MIDDLE]
            out[LINKED] += one[LINKED]
            out[LINKED, none] += self.product(r2 * w, t)

    def look(self, seen: np.ndarray, ml: np.ndarray, i: np.ndarray, near: np.ndarray, mr: np.ndarray, ls: np.ndarray, close: np.ndarray, once: np.ndarray) -> None:
        """Marks the groups that some quadruple with i other than l has."""
        g, m, n = len(ml), ml.shape[1], near.shape[1]
        count = [(z.reshape(g * m, -1) @ near).reshape(g, m, n) for z in (ml, ml * (i + 1.0))]
        back = [(z.reshape(g * n, -1) @ close.T).reshape(g, n, m).transpose(0, 2, 1) for z in (mr, mr * (ls + 1.0))]
        for p in range(g):
            for q in range(g):
                if not (seen[p, q] and seen[q, p]):
                    some = once & (count[0][p] > 0) & (back[0][q] > 0)
                    if (some & ~((count[0][p] == 1) & (back[0][q] == 1) & (count[1][p] == back[1][q]))).any():
                        seen[p, q] = seen[q, p] = True

    def take_off(self, out: np.ndarray, c: Cloud, rows: np.ndarray, others: np.ndarray, pieces: list) -> None:
        """Less the tuples in which l is i: j and k other points with legs and links to i."""
        n, m, width, groups = self.leg.n, len(rows), self.leg.width, self.leg.groups
        many = len(c.jacks) + 1 if self.regions else 1
        v, vv = np.zeros((m, many, width)), np.zeros((m, many, groups, n, n))
        for p, q, g, s, mu, f in pieces:
            ok = s < self.cut
            p, q, g, s, mu, f = p[ok], q[ok], g[ok], s[ok], mu[ok], None if f is None else f[:, ok]
            value = c.w[others[q]] * self.xi(s, mu)
            at = (p * many + (c.jack[others[q]] if self.regions else 0)) * groups + g
            full = m * many * groups
            for one in range(n):
                own = value if f is None else value * f[one]
                v.reshape(m, many, groups, n)[..., one] += np.bincount(at, own, full).reshape(m, many, groups)
                for two_ in range(n):
                    vv[..., one, two_] += np.bincount(at, own * (value if f is None else value * f[two_]), full).reshape(m, many, groups)
        w2 = c.w[rows] ** 2
        diagonal = np.zeros((many, width, width))
        summed = np.einsum("i,irgpq->rgpq", w2, vv)
        for g in range(groups):
            diagonal[:, g * n : (g + 1) * n, g * n : (g + 1) * n] = summed[:, g]
        whole = v.sum(axis=1)
        total = np.einsum("i,ia,ib->ab", w2, whole, whole) - diagonal.sum(axis=0)
        if not self.regions:
            out[TOTAL, 0] -= total
            return
        none = many - 1
        out[TOTAL, none] -= total
        out[FIRST] -= np.einsum("i,ira,ib->rab", w2, v, whole) - diagonal
        out[MIDDLE, none] -= np.einsum("i,ira,irb->ab", w2, v[:, :none], v[:, :none]) - diagonal[:none].sum(axis=0)
        own = c.jack[rows]
        for r in np.unique(own[own < none]):
            at = own == r
            same = np.einsum("i,igpq->gpq", w2[at], vv[at, r])
            d = np.zeros((width, width))
            for g in range(groups):
                d[g * n : (g + 1) * n, g * n : (g + 1) * n] = same[g]
            out[LINKED, none] -= np.einsum("i,ia,ib->ab", w2[at], whole[at], v[at, r]) - d

    def rows(self, state: dict, a: Cloud, b: Cloud) -> list:
        sums, width, n = state["sum"], self.leg.width, self.leg.n
        seen = np.repeat(np.repeat(state["seen"], n, axis=0), n, axis=1)
        none = sums.shape[1] - 1
        cols: list[list] = [[] for _ in range(6)]
        for kind in range(5):
            for r in range(sums.shape[1]):
                if kind in (TOTAL, MIDDLE, LINKED) and r != none:
                    continue
                at = np.argwhere(seen) if kind == TOTAL else np.argwhere(sums[kind, r] != 0)
                # A total that some other task knows to be there is kept here too.
                at = np.argwhere(seen | (sums[kind, r] != 0)) if kind == TOTAL else at
                label = None if kind in (TOTAL, MIDDLE, LINKED) or r == none else int(a.jacks[r])
                for x, y in at:
                    for c, v in zip(cols, (kind, int(x), int(y), label, int(seen[x, y]) if kind == TOTAL else 0, float(sums[kind, r, x, y])), strict=True):
                        c.append(v)
        return cols


def sums(points: DataFrame, leg: Leg, cut: float, xi: Callable, four: bool, isotropic: bool = False, regions: bool = False, leaf: int = 128) -> DataFrame:
    """kind, a, b, jack, n, value of Sums, added up. xi: of s and mu as arrays; of s and None where it is isotropic."""
    work = Sums(leg, cut, xi, four, isotropic, regions)
    reach = leg.r_max + (cut if four else 0)
    got = blocks.over_leaves(points, None, reach, work, ROWS, ("w", "jack") if regions else ("w",), leaf=leaf)
    return got.groupBy("kind", "a", "b", "jack").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))


def three(points: DataFrame, leg: Leg, cut: float, xi: Callable, isotropic: bool = False) -> DataFrame:
    """a, b, value: 4 sum w_i w_j^2 w_k xi_ik by the columns of ij and jk."""
    return sums(points, leg, cut, xi, False, isotropic).where("n > 0").select("a", "b", (4 * F.col("value")).alias("value"))


def four(points: DataFrame, leg: Leg, cut: float, xi: Callable, isotropic: bool = False) -> DataFrame:
    """a, b, value: 2 sum w_i w_j w_k w_l xi_ik xi_jl by the columns of ij and kl."""
    return sums(points, leg, cut, xi, True, isotropic).where("n > 0").select("a", "b", (2 * F.col("value")).alias("value"))


def jackknifed(got: DataFrame, weights: DataFrame, products: DataFrame, four_points: bool) -> DataFrame:
    """a, b, value: the sums with the weights of terms.tensor, from sums by region. All tables are bins x bins x regions.

    Exchanging i and k in a triple exchanges a and b, so that sums by i's region are those by k's turned about; in a quadruple
    i, j and k, l may be exchanged, and ij with kl."""
    v, zero, no = F.col("value"), F.lit(0.0), F.lit(None).cast("int")

    def part(a, b, hit, at, v, total=zero):
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"), hit.alias("hit"), at.alias("bin"), v.alias("v"), total.alias("total"), F.col("n").alias("n"))

    if four_points:
        parts = {FIRST: [part("a", "b", zero, F.col("b"), 2 * v), part("b", "a", zero, F.col("b"), 2 * v)], MIDDLE: [part("a", "b", 2 * v, no, zero)], LINKED: [part("a", "b", 2 * v, no, zero)]}
    else:
        own = F.when(F.col("jack").isNotNull(), v).otherwise(0.0)
        parts = {FIRST: [part("a", "b", own, F.col("b"), v), part("a", "b", zero, F.col("a"), v)], SECOND: [part("a", "b", zero, F.col("a"), v), part("b", "a", zero, F.col("a"), v)],
                 MIDDLE: [part("a", "b", v, no, zero), part("b", "a", v, no, zero)], LINKED: [part("a", "b", v, no, zero)]}
    every = F.when(F.col("kind") == TOTAL, F.array(part("a", "b", zero, no, zero, v)))
    for kind, own_parts in parts.items():
        every = every.when(F.col("kind") == kind, F.array(*own_parts))
    each = got.select("jack", F.explode(every).alias("p")).select("jack", "p.*")  # one pass: the sums are made once
    each = each.join(F.broadcast(weights.select("jack", "bin", "weight")), ["jack", "bin"], "left")
    q = F.sum(0.25 * F.col("hit") - 0.5 * F.coalesce("weight", F.lit(0.0)) * F.col("v"))
    out = each.groupBy("a", "b").agg(q.alias("q"), F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0")
    out = out.join(F.broadcast(products.select(F.col("bin_a").alias("a"), F.col("bin_b").alias("b"), F.col("value").alias("p"))), ["a", "b"])
    times = 2 if four_points else 4
    return out.select("a", "b", (times * (F.col("q") + F.col("p") * F.col("total")) / (1 - F.col("p"))).alias("value"))
