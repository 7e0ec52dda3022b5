"""Seeded importance sampling of the 2-, 3- and 4-point terms: the plan for catalogs too large for exact joins.

The volume is cut into blocks of cells. A task gets one block and some loops; every draw comes from a counter-based
generator keyed by (seed, loop, block), so results do not depend on partitioning or retries. Partner cells are drawn from
kernels over cell offsets (a 1/r^2 kernel for pairs, a correlation kernel for the other legs) by alias tables, then a
point uniformly in its cell; sums are divided by the draws' probabilities.

Catalogs of at most `SENT` points (counted first) go to all executors whole. Of larger ones a task receives the points of
its block and of a halo as wide as the kernels' reach, as copies of them dealt by block; draws and results are the same
either way. The same draws serve plain and jackknife terms, (s, mu) bins and accumulated Legendre moments, one tracer and
the seven combinations of two.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galacov.operators.pairs import Bins

#: Most points of catalogs that are sent to all executors, 64 bytes each.
SENT = 2_000_000
#: Draws of fourth points that a task holds at once.
DRAWS = 1 << 21
#: First points of a block that one task takes, with draws of their own: a full block is shared by as many tasks as it needs.
PIECE = 2048
COLUMNS = ("id", "x", "y", "z", "w", "jack", "half", "tracer")


# ---- kernels ---------------------------------------------------------------------------------------------------------
def alias_table(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of staying and the other outcome, for draws in constant time (Walker, 1977; Vose, 1991)."""
    n = len(p)
    q = np.asarray(p, float) * n / p.sum()
    stay, other = np.ones(n), np.arange(n)
    small, large = list(np.flatnonzero(q < 1)), list(np.flatnonzero(q >= 1))
    while small and large:
        s, g = small.pop(), large.pop()
        stay[s], other[s] = q[s], g
        q[g] -= 1 - q[s]
        (small if q[g] < 1 else large).append(g)
    return stay, other


def draw(table: tuple[np.ndarray, np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    i = (u * len(table[0])).astype(np.int64)
    return np.where(v < table[0][i], i, table[1][i])


def dawson(x: np.ndarray) -> np.ndarray:
    """exp(-x^2) times the integral of exp(t^2) from 0 to x (Rybicki's sampling formula)."""
    h = 0.4
    x = np.asarray(x, float)
    n0 = 2 * np.round(0.5 * np.abs(x) / h)
    y = np.abs(x) - n0 * h
    total = np.zeros_like(x)
    for k in range(-23, 24, 2):
        total += np.exp(-((y - k * h) ** 2)) / (n0 + k)
    return np.sign(x) * total / np.sqrt(np.pi)


def offsets(reach: int) -> np.ndarray:
    r = np.arange(-reach, reach + 1)
    return np.stack(np.meshgrid(r, r, r, indexing="ij"), axis=-1).reshape(-1, 3)


def inverse_square_kernel(reach: int, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and their probabilities, proportional to the mean of 1/r^2 over two cells."""
    d = offsets(reach)
    n = cell * np.sqrt((d**2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(n > 0, dawson(n / cell) / (cell * n), cell**-2.0)
    return d, p / p.sum()


def correlation_kernel(reach: int, cell: float, xi: Callable[[np.ndarray], np.ndarray], nodes: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Proportional to xi smoothed by the distribution of distances between points of two cells; never negative."""
    d = offsets(reach)
    n = cell * np.sqrt((d**2).sum(axis=1))
    far, inverse = np.unique(np.round(n, 9), return_inverse=True)
    x, w = np.polynomial.legendre.leggauss(nodes)
    top = 2 * cell * max(reach, 1)
    x, w = top * (x + 1) / 2, w * top / 2
    value = xi(x)
    value = np.where(value < 1e-10, 10 / x**2, value)
    r = cell / 2
    p = np.empty(len(far))
    for i, m in enumerate(far):
        if m == 0:
            p[i] = (w * x**2 * value / r**3 * np.exp(-((x / (2 * r)) ** 2))).sum()
        else:
            p[i] = (w * x / (r * m) * (np.exp(-(((x - m) / (2 * r)) ** 2)) - np.exp(-(((x + m) / (2 * r)) ** 2))) * value).sum()
    p = np.maximum(p, 0)[inverse]
    return d, p / p.sum()


# ---- grid ------------------------------------------------------------------------------------------------------------
@dataclass
class Grid:
    """Points in the order of their cells. cells: coordinates of filled cells; start, count: their points."""

    xyz: np.ndarray
    w: np.ndarray
    ids: np.ndarray
    jack: np.ndarray
    half: np.ndarray
    cells: np.ndarray
    start: np.ndarray
    count: np.ndarray
    shape: tuple[int, int, int]
    index: np.ndarray
    periodic: bool = False
    box: float = 0.0

    def find(self, c: np.ndarray) -> np.ndarray:
        """Number of the filled cell at each coordinate, -1 where it is empty or outside."""
        if self.periodic:
            c = c % np.array(self.shape)
            ok = np.ones(len(c), bool)
        else:
            ok = ((c >= 0) & (c < np.array(self.shape))).all(axis=1)
            c = np.where(ok[:, None], c, 0)
        flat = (c[:, 0] * self.shape[1] + c[:, 1]) * self.shape[2] + c[:, 2]
        if not len(self.index):
            return np.full(len(c), -1)
        at = np.searchsorted(self.index, flat)
        at = np.minimum(at, len(self.index) - 1)
        return np.where(ok & (self.index[at] == flat), at, -1)


@dataclass(frozen=True)
class Space:
    """The cells of a run: low corner, side, number along each axis; box: side of a periodic volume or 0."""

    low: tuple[float, float, float]
    cell: float
    shape: tuple[int, int, int]
    box: float = 0.0

    def grid(self, t: dict[str, np.ndarray]) -> Grid:
        xyz = np.stack([t[c] for c in "xyz"], axis=1)
        own = np.floor((xyz - np.array(self.low)) / self.cell).astype(np.int64) % np.array(self.shape)
        flat = (own[:, 0] * self.shape[1] + own[:, 1]) * self.shape[2] + own[:, 2]
        order = np.lexsort((t["id"], flat))
        index, start, count = np.unique(flat[order], return_index=True, return_counts=True)
        return Grid(xyz[order], t["w"][order], t["id"][order], t["jack"][order], t["half"][order], own[order][start], start, count, self.shape, index, bool(self.box), self.box)


def space_of(points: list[DataFrame], cell: float, box: float = 0.0) -> Space:
    if box:
        return Space((0.0, 0.0, 0.0), cell, (int(round(box / cell)),) * 3, box)
    ends = [p.agg(*[f(c).alias(f"{c}{n}") for c in "xyz" for n, f in ((0, F.min), (1, F.max))]).first() for p in points]
    low = [min(e[f"{c}0"] for e in ends) for c in "xyz"]
    high = [max(e[f"{c}1"] for e in ends) for c in "xyz"]
    return Space(tuple(low), cell, tuple(int((h - lo) // cell) + 1 for lo, h in zip(low, high, strict=True)))


def columns_of(points: DataFrame, tracer: int) -> DataFrame:
    """COLUMNS; regions and halves are 0 where the catalog has none."""
    other = [F.col(c).cast("int").alias(c) if c in points.columns else F.lit(0).alias(c) for c in ("jack", "half")]
    return points.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyzw"], *other, F.lit(tracer).alias("tracer"))


def arrays(t: pa.Table) -> dict[str, np.ndarray]:
    return {c: t.column(c).to_numpy() for c in COLUMNS}


# ---- draws -----------------------------------------------------------------------------------------------------------
def rng_of(seed: int, loop: int, block: int, piece: int = 0) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[(seed << 32) ^ loop, block], counter=[0, 0, 0, piece]))


def geometry_of(g: Grid, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = a - b
    if g.periodic:
        d = d - g.box * np.round(d / g.box)
    s = np.sqrt((d**2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        if g.periodic:
            mu = np.abs(d[:, 2]) / s
        else:
            m = a + b
            mu = np.abs((d * m).sum(axis=1)) / (s * np.sqrt((m**2).sum(axis=1)))
    return s, np.where(s > 0, mu, 0)


def bin_of(bins: Bins, s: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Flat bin or -1."""
    r = np.full(len(s), -1)
    for i, (lo, hi) in enumerate(bins.edges):
        r[(s >= lo) & (s < hi)] = i
    m = np.minimum(np.floor((mu - bins.mu_low) / ((bins.mu_high - bins.mu_low) / bins.n_mu)).astype(int), bins.n_mu - 1)
    inside = (r >= 0) & (mu >= bins.mu_low) & (mu <= bins.mu_high) & (s > 0)
    return np.where(inside, r * bins.n_mu + m, -1)


def partner(g: Grid, cells: np.ndarray, kernel, table, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cell coordinate a drawn point (-1: the cell is empty), its cell, and the draw's probability."""
    d, p = kernel
    pick = draw(table, rng.random(len(cells)), rng.random(len(cells)))
    there = cells + d[pick]
    if g.periodic:
        there = there % np.array(g.shape)
    found = g.find(there)
    n = np.where(found >= 0, g.count[found], 1)
    point = np.where(found >= 0, g.start[found] + (rng.random(len(cells)) * n).astype(np.int64), -1)
    return point, there, p[pick] / n


@dataclass
class Terms:
    """What a task needs beside points. kernels: (offsets, probabilities) and alias table of the pair kernel, and of the
    correlation kernels by tracer pair; xis: correlation functions by tracer pair. jack: weights [region, bin] and products
    [bin, bin] by pair of tracer pairs. legendre: max_l, phi(r_bin, mu) and the shells' volumes."""

    bins: Bins
    n2: int
    n3: int
    n4: int
    pair: tuple
    links: dict
    xis: dict
    combinations: tuple = ((1, 1, 1, 1),)
    jack: dict | None = None
    legendre: tuple | None = None
    n: int = field(init=False)

    def __post_init__(self):
        self.n = len(self.bins.edges) * (self.legendre[0] // 2 + 1 if self.legendre else self.bins.n_mu)

    def place(self, s: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Bins of pairs, -1 outside; with Legendre moments the radial bin, and a factor for each moment."""
        if not self.legendre:
            return bin_of(self.bins, s, mu), None
        max_l, phi, volumes = self.legendre
        r = bin_of(Bins(self.bins.edges, 1, 0.0, 1.0), s, mu)
        inside = np.maximum(r, 0)
        f = phi(inside, mu) / np.asarray(volumes)[inside]
        return r, np.stack([f * (2 * k + 1) * np.polynomial.legendre.legval(mu, [0] * k + [1]) for k in range(0, max_l + 1, 2)], axis=1)

    def sums(self, a, fa, b, fb, value) -> np.ndarray:
        """value summed over the bins, or moments, of both pairs."""
        if fa is None:
            return np.bincount(a * self.n + b, value, self.n**2)
        m, out = fa.shape[1], np.zeros(self.n**2)
        for p in range(m):
            for q in range(m):
                out += np.bincount((a * m + p) * self.n + b * m + q, value * fa[:, p] * fb[:, q], self.n**2)
        return out

    def tensor(self, pairs: tuple, regions: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Jackknife weight of tuples, see terms.tensor; regions of the points of pair a, then of pair b."""
        wa, wb, product = self.jack[pairs]
        ji, jj, jk, jl = regions
        same = (ji == jk) * 0.25 + (jj == jk) * 0.25 + (ji == jl) * 0.25 + (jj == jl) * 0.25
        p = product[a, b]
        return (same - 0.5 * (wb[ji, b] + wb[jj, b] + wa[jk, a] + wa[jl, a]) + p) / (1 - p)


def pair_of(t1: int, t2: int) -> tuple[int, int]:
    return (min(t1, t2), max(t1, t2))


def sampled_block(plan: Terms, grids: dict[int, Grid], combination: tuple, rng, primaries: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over draws from the given points i of the first tracer: c2, c3, c4 (and c2j, c3j, c4j) as n x n, rr by bin,
    rr1, ee1, rr2, ee2 by region and bin, and counts of quads tried (as if every draw were carried on), drawn and used."""
    t1, t2, t3, t4 = combination
    g1, g2, g3, g4 = (grids[t] for t in combination)
    n, n2, n3, n4 = plan.n, plan.n2, plan.n3, plan.n4
    out: dict[str, np.ndarray] = {"tried": np.array([float(len(primaries) * n2 * n3 * n4)])}
    p12, p23, p34 = pair_of(t1, t2), pair_of(t2, t3), pair_of(t3, t4)
    xi12, xi13, xi24 = (plan.xis[pair_of(*p)] for p in ((t1, t2), (t1, t3), (t2, t4)))
    cell_of = g1.cells[np.searchsorted(g1.start, primaries, side="right") - 1]
    i, ci = np.repeat(primaries, n2), np.repeat(cell_of, n2, axis=0)
    j, cj, pj = partner(g2, ci, *plan.pair, rng)
    s, mu = geometry_of(g1, g1.xyz[i], g2.xyz[j])
    a, fa = plan.place(s, mu)
    hit = (j >= 0) & (a >= 0) & ~((j == i) & (t1 == t2))
    i, ci, j, cj, pj, s, mu, a = i[hit], ci[hit], j[hit], cj[hit], pj[hit], s[hit], mu[hit], a[hit]
    fa = None if fa is None else fa[hit]
    wij = g1.w[i] * g2.w[j]
    f = wij / pj / n2
    xij = xi12(s, mu) if len(s) else s
    two = 2 * f * wij * (1 + xij)
    if not plan.legendre:
        out["rr"] = np.bincount(a, f, n)
    out["c2"] = plan.sums(a, fa, a, fa, two)
    if plan.jack:
        ji, jj = g1.jack[i], g2.jack[j]
        if (p12, p12) in plan.jack:
            out["c2j"] = plan.sums(a, None, a, None, two * plan.tensor((p12, p12), (ji, jj, ji, jj), a, a))
        regions = plan.jack[p12, p12][0].shape[0]
        for h in (0, 1):  # pairs of one half are a quarter of all
            own = (g1.half[i] == h) & (g2.half[j] == h)
            flat, v = np.concatenate([ji[own] * n + a[own], jj[own] * n + a[own]]), np.tile(2 * f[own], 2)
            out[f"rr{h + 1}"] = np.bincount(flat, v, regions * n)
            out[f"ee{h + 1}"] = np.bincount(flat, v * np.tile(xij[own], 2), regions * n)
    # Third point: from i's cell by the correlation kernel.
    up = lambda m, *arrays: [None if x is None else np.repeat(x, m, axis=0) for x in arrays]
    i, ci, j, cj, a, pj, fa = up(n3, i, ci, j, cj, a, pj, fa)
    k, _, pk = partner(g3, ci, *plan.links[pair_of(t1, t3)], rng)
    ok = (k >= 0) & ~((k == i) & (t1 == t3)) & ~((k == j) & (t2 == t3))
    i, j, cj, a, pj, k, pk = i[ok], j[ok], cj[ok], a[ok], pj[ok], k[ok], pk[ok]
    fa = None if fa is None else fa[ok]
    x = xi13(*geometry_of(g1, g1.xyz[i], g3.xyz[k])) if len(k) else pk
    pijk = pj * pk
    b, fb = plan.place(*geometry_of(g2, g2.xyz[j], g3.xyz[k]))
    h = b >= 0
    three = 4 * (g1.w[i] * g2.w[j] ** 2 * g3.w[k] * x / pijk)[h] / (n2 * n3)
    out["c3"] = plan.sums(a[h], None if fa is None else fa[h], b[h], None if fb is None else fb[h], three)
    if plan.jack and (p12, p23) in plan.jack:
        out["c3j"] = plan.sums(a[h], None, b[h], None, three * plan.tensor((p12, p23), (g1.jack[i[h]], g2.jack[j[h]], g2.jack[j[h]], g3.jack[k[h]]), a[h], b[h]))
    # Fourth point: from j's cell.
    i, j, cj, k, a, x, pijk, fa = up(n4, i, j, cj, k, a, x, pijk, fa)
    m, _, pl = partner(g4, cj, *plan.links[pair_of(t2, t4)], rng)
    out["drawn"] = np.array([float(len(m))])
    there = (m >= 0) & ~((m == i) & (t1 == t4)) & ~((m == j) & (t2 == t4)) & ~((m == k) & (t3 == t4))
    b, fb = plan.place(*geometry_of(g3, g3.xyz[k], g4.xyz[m]))
    ok = there & (b >= 0)
    i, j, k, a, x, pijk, m, pl, b = (v[ok] for v in (i, j, k, a, x, pijk, m, pl, b))
    y = xi24(*geometry_of(g2, g2.xyz[j], g4.xyz[m])) if len(m) else pl
    four = 2 * g1.w[i] * g2.w[j] * g3.w[k] * g4.w[m] * x * y / (pijk * pl) / (n2 * n3 * n4)
    out["c4"] = plan.sums(a, None if fa is None else fa[ok], b, None if fb is None else fb[ok], four)
    if plan.jack and (p12, p34) in plan.jack:
        out["c4j"] = plan.sums(a, None, b, None, four * plan.tensor((p12, p34), (g1.jack[i], g2.jack[j], g3.jack[k], g4.jack[m]), a, b))
    out["used"] = np.array([float(len(m))])
    return out


def block_of(cells: np.ndarray, side: int, shape: tuple) -> np.ndarray:
    """Number of the block of cells that each cell coordinate lies in."""
    n = -(-np.array(shape) // side)
    b = cells // side
    return (b[:, 0] * n[1] + b[:, 1]) * n[2] + b[:, 2]


def run_block(plan: Terms, grids: dict[int, Grid], side: int, block: int, loops: list[int], loops_per_sample: int, seed: int, piece: int = 0) -> pa.RecordBatch:
    """(combination, term, subsample, row, col, value) of one piece of a block and these loops."""
    totals: dict[tuple, np.ndarray] = {}
    some = max(16, DRAWS // (plan.n2 * plan.n3 * plan.n4))
    for c, combination in enumerate(plan.combinations):
        g = grids[combination[0]]
        filled = np.flatnonzero(block_of(g.cells, side, g.shape) == block)
        own = np.concatenate([np.arange(g.start[f], g.start[f] + g.count[f]) for f in filled]) if len(filled) else np.zeros(0, np.int64)
        own = own[piece * PIECE : (piece + 1) * PIECE]
        for loop in loops if len(own) else []:
            rng = rng_of(seed, loop, block * len(plan.combinations) + c, piece)
            for at in range(0, len(own), some):
                for name, v in sampled_block(plan, grids, combination, rng, own[at : at + some]).items():
                    key = (c, name, loop // loops_per_sample)
                    totals[key] = totals[key] + v if key in totals else v
    cols: list[list] = [[], [], [], [], [], []]
    for (c, name, sub), v in totals.items():
        at = np.flatnonzero(v)
        wide = plan.n if name[0] in "cre" and name != "rr" else 0
        row, col = (at // wide, at % wide) if wide else (at, at)
        for x, got in zip(cols, ([c] * len(at), [name] * len(at), [sub] * len(at), row, col, v[at]), strict=True):
            x.extend(got)
    types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["combination", "term", "subsample", "row", "col", "value"])


SUMS = "combination int, term string, subsample int, row int, col int, value double"


def pieces_of(grids: dict[int, Grid], side: int, shape: tuple) -> dict[int, int]:
    """How many pieces each filled block has, by the tracer that has most points there."""
    most: dict[int, int] = {}
    for g in grids.values():
        number, at = np.unique(block_of(g.cells, side, shape), return_inverse=True)
        for b, n in zip(number.tolist(), np.bincount(at, g.count, len(number)).tolist(), strict=True):
            most[b] = max(most.get(b, 0), int(n))
    return {b: max(1, -(-n // PIECE)) for b, n in most.items()}


def over_blocks(catalogs: dict[int, DataFrame], space: Space, halo: int, side: int, parts: list, state, run_part: Callable, schema: str, sent: int = SENT, pieces: bool = False) -> DataFrame:
    """Rows of run_part(state, grids, block, part) -> RecordBatch for all blocks and parts. halo: the farthest cell, along
    an axis, that a draw from a cell can reach; state goes to all executors. pieces: run_part takes the number of a piece too."""
    spark, tracers = next(iter(catalogs.values())).sparkSession, list(catalogs)
    points = None
    for t, p in catalogs.items():
        points = columns_of(p, t) if points is None else points.unionByName(columns_of(p, t))
    n_blocks = -(-np.array(space.shape) // side)
    if points.count() <= sent:
        got = arrays(points.toArrow())
        state = cloudpickle.dumps(state)  # it may hold functions
        whole = spark.sparkContext.broadcast((state, {t: vars(space.grid({c: v[got["tracer"] == t] for c, v in got.items()})) for t in catalogs}))
        shares = pieces_of({t: Grid(**g) for t, g in whole.value[1].items()}, side, space.shape)
        filled = [(b, n) for b, many in sorted(shares.items()) for n in (range(many) if pieces else (0,))]
        blocks = spark.createDataFrame(filled, "block long, piece long").crossJoin(F.broadcast(spark.range(len(parts)).toDF("part")))
        n_tasks = len(filled) * len(parts)
        tasks = blocks.repartition(max(1, min(n_tasks, 3 * spark.sparkContext.defaultParallelism)), "block", "part", "piece")

        def run(batches):
            own, grids = whole.value
            own, grids = pickle.loads(own), {t: Grid(**g) for t, g in grids.items()}
            for batch in batches:
                for block, piece, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    yield run_part(own, grids, block, parts[part], *((piece,) if pieces else ()))

        return tasks.mapInArrow(run, schema)
    alone = spark.sparkContext.broadcast(cloudpickle.dumps(state))

    def near(c: str, low: float, many: int, cells: int):
        """Numbers of the blocks along an axis whose halo has the point."""
        own = F.pmod(F.floor((F.col(c) - F.lit(low)) / F.lit(space.cell)).cast("long"), F.lit(cells))
        steps = -(-halo // side)
        b = F.floor(own / side).cast("long")
        around = F.sequence(b - steps, b + steps)
        reached = F.filter(around, lambda k: (own >= k * side - halo) & (own < (k + 1) * side + halo))
        if space.box:  # blocks at the end of a periodic axis may be narrower: take all that the wrapped halo may touch
            return F.array_distinct(F.transform(F.sequence(b - steps - 1, b + steps + 1), lambda k: F.pmod(k, F.lit(many))))
        return F.filter(reached, lambda k: (k >= 0) & (k < many))

    copies = points
    for c, low, many, cells in zip("xyz", space.low, n_blocks.tolist(), space.shape, strict=True):
        copies = copies.withColumn(f"b{c}", F.explode(near(c, low, many, cells)))
    copies = copies.withColumn("block", (F.col("bx") * int(n_blocks[1]) + F.col("by")) * int(n_blocks[2]) + F.col("bz")).drop("bx", "by", "bz")

    def run_group(t: pa.Table) -> pa.Table:
        own, got = pickle.loads(alone.value), arrays(t)
        block = t.column("block")[0].as_py()
        grids = {k: space.grid({c: v[got["tracer"] == k] for c, v in got.items()}) for k in tracers}
        many = range(pieces_of(grids, side, space.shape).get(block, 1)) if pieces else ()
        return pa.Table.from_batches([run_part(own, grids, block, part, *piece) for part in parts for piece in ([(n,) for n in many] or [()])])

    return copies.groupBy("block").applyInArrow(run_group, schema)


def sample(points: DataFrame, bins: Bins, xi, xi_cut: float, cell: float, n2: int = 5, n3: int = 10, n4: int = 20, loops: int = 16, loops_per_sample: int = 4,
           seed: int = 1, box: float = 0.0, second: DataFrame | None = None, jack: dict | None = None, legendre: tuple | None = None,
           combinations: tuple | None = None, side: int | None = None, sent: int = SENT) -> DataFrame:
    """term, subsample, row, col, value (with a second catalog also t1 to t4, the points' tracers): the terms' sums, not yet
    divided by norms or pair counts. Terms: c2, c3, c4, rr; with jack also c2j, c3j, c4j and, by region, rr1, ee1, rr2,
    ee2; used, drawn and tried count quads. xi: a callable (s, mu) with a method isotropic(r), or three by tracer pair.
    jack: by (pair, pair) of tracer pairs the weights [region, bin] of either pair and their products [bin, bin].
    legendre: (max_l, phi, volumes) for accumulated moments; row and col are then r_bin x moments + l / 2."""
    catalogs = {1: points} if second is None else {1: points, 2: second}
    xis = xi if isinstance(xi, dict) else {(1, 1): xi}
    chosen = combinations or (((1, 1, 1, 1),) if second is None else COMBINATIONS)
    space = space_of(list(catalogs.values()), cell, box)
    reach, far = max(1, int(np.ceil(2 * bins.r_max / cell))), max(1, int(np.ceil(xi_cut / cell)))
    pair = inverse_square_kernel(reach, cell)
    links = {p: correlation_kernel(far, cell, f.isotropic) for p, f in xis.items()}
    plan = Terms(bins, n2, n3, n4, (pair, alias_table(pair[1])), {p: (k, alias_table(k[1])) for p, k in links.items()}, xis, chosen, jack, legendre)
    halo = reach + far
    side = side or 2 * halo
    # Whole subsamples where there are enough of them, so that a task adds up what it can.
    many = loops * int((-(-np.array(space.shape) // side)).prod()) // max(1, 4 * points.sparkSession.sparkContext.defaultParallelism)
    share = max(1, min(loops_per_sample, many))
    parts = [list(range(i, min(i + share, loops))) for i in range(0, loops, share)]
    work = lambda own, grids, block, part, piece: run_block(own, grids, side, block, part, loops_per_sample, seed, piece)
    sums = over_blocks(catalogs, space, halo, side, parts, plan, work, SUMS, sent, pieces=True)
    sums = sums.groupBy("combination", "term", "subsample", "row", "col").agg(F.sum("value").alias("value"))
    per = F.when(F.col("term").isin("used", "drawn", "tried"), F.col("value")).otherwise(F.col("value") / loops_per_sample)
    sums = sums.withColumn("value", per)
    if second is None:
        return sums.drop("combination")
    names = F.array(*[F.array(*map(F.lit, c)) for c in chosen])
    return sums.select(*[names[F.col("combination")][k].alias(f"t{k + 1}") for k in range(4)], "term", "subsample", "row", "col", "value")


#: The tracer combinations (of the pairs ij and kl) of a two-tracer run.
COMBINATIONS = ((1, 1, 1, 1), (1, 2, 1, 1), (1, 2, 2, 1), (1, 2, 1, 2), (1, 1, 2, 2), (2, 1, 2, 2), (2, 2, 2, 2))


def jack_arrays(weights: DataFrame, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights [region, bin] and products [bin, bin] of (jack, bin, weight): regions x bins rows, whatever the catalog."""
    rows = weights.select("jack", "bin", "weight").toArrow()
    jack, bins_, w = (rows.column(i).to_numpy() for i in range(3))
    out = np.zeros((int(jack.max()) + 1 if len(jack) else 1, n_bins))
    out[jack, bins_] = np.nan_to_num(w)
    return out, out.T @ out


def pair_draws(points: DataFrame, per_point: int, cell: float, reach: int, seed: str = "draw") -> DataFrame:
    """id1, draw, id2: the relational form of a pair draw, from md5 uniforms: an offset by inverse cumulative sums, then a
    point of the drawn cell. Rows whose cell is empty are left out."""
    from galacov.operators import catalog

    spark = points.sparkSession
    d, p = inverse_square_kernel(reach, cell)
    edge = np.floor(np.cumsum(p) * 2**32).astype(np.int64)
    edge[-1] = 2**32
    steps = spark.createDataFrame([(int(lo), int(hi), *map(int, o)) for lo, hi, o in zip(np.concatenate([[0], edge[:-1]]), edge, d, strict=True) if hi > lo], "lo long, hi long, dx int, dy int, dz int")
    celled = catalog.cells(points.select("id", "x", "y", "z"), cell)
    drawn = celled.select("id", "cx", "cy", "cz", F.explode(F.sequence(F.lit(0), F.lit(per_point - 1))).alias("draw"))
    drawn = drawn.withColumn("u", catalog.hashed(F.concat_ws("-", "id", "draw"), seed + "-o")).withColumn("v", catalog.hashed(F.concat_ws("-", "id", "draw"), seed + "-p"))
    # The offsets are (2 reach + 1)^3 rows in order of their sums; a draw finds its own by a search in that array.
    table = steps.agg(F.array_sort(F.collect_list(F.struct("hi", "dx", "dy", "dz"))).alias("t"))
    found = drawn.crossJoin(F.broadcast(table)).withColumn("o", F.filter("t", lambda x: x["hi"] > F.col("u"))[0])
    there = found.select(F.col("id").alias("id1"), "draw", "v", *[(F.col(f"c{c}") + F.col(f"o.d{c}")).alias(f"c{c}") for c in "xyz"])
    numbered = catalog.numbered(celled).select("cx", "cy", "cz", "pos", "np", F.col("id").alias("id2"))
    met = there.join(numbered, ["cx", "cy", "cz"])
    return met.where(F.col("pos") == F.floor(F.col("v") * F.col("np") / F.lit(2.0**32))).select("id1", "draw", "id2")
