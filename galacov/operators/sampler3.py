"""Sampled terms of the isotropic three-point function: 3 to 6 points, both topologies of how triangles hang together.

Points are drawn one after another, each from the cell of an earlier one, by the 1/r^2 or the correlation kernel:
topology 0 is the chain j~xi(i), k~1/r^2(j), l~xi(k), m~xi(l), n~xi(m); topology 1 is j~1/r^2(i), k~xi(j), l~xi(i), m~xi(j),
n~xi(k). The two triangles are ijk with ijk, jkl, klm or lmn for 3, 4, 5 and 6 points.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galacov.functions.geometry import legendre_coefficients
from galacov.operators import sampler
from galacov.operators.pairs import Bins

#: Which earlier point each new one (j, k, l, m, n) hangs on, and by which kernel (True: correlation).
CHAINS = {0: ((0, True), (1, False), (2, True), (3, True), (4, True)), 1: ((0, False), (1, True), (0, True), (1, True), (2, True))}
SECOND = {3: (0, 1, 2), 4: (1, 2, 3), 5: (2, 3, 4), 6: (3, 4, 5)}
#: Prefactor and links of the correlation product, by (points, topology); a fifth link (i, j) with + 1 is in PLUS_ONE.
FACTORS = {(3, 0): (3, ()), (3, 1): (3, ()), (4, 0): (36, ((2, 3), (0, 1))), (4, 1): (18, ((0, 3),)), (5, 0): (9, ((3, 4), (0, 1))), (5, 1): (18, ((1, 4), (0, 3))),
           (6, 0): (9, ((4, 5), (2, 3), (0, 1))), (6, 1): (6, ((1, 4), (2, 5), (0, 3)))}
PLUS_ONE = {(3, 0): (3.0, (0, 1)), (3, 1): (3.0, (1, 2)), (4, 1): (1.0, (1, 2))}


def chosen_sides(g, points: tuple, bins: Bins, max_l: int):
    """For the three corners of a triangle: flat index of its two radial bins (-1: outside) and the moments of its angle."""
    d = {}
    for a, b in itertools.combinations(range(3), 2):
        d[a, b], _ = sampler.geometry_of(g, g.xyz[points[a]], g.xyz[points[b]])
    n = len(bins.edges)
    radial = {k: sampler.bin_of(Bins(bins.edges), v, np.full(len(v), 0.5)) for k, v in d.items()}
    out = []
    for corner in range(3):
        a, b = (x for x in range(3) if x != corner)
        e, f = tuple(sorted((corner, a))), tuple(sorted((corner, b)))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.clip((d[e] ** 2 + d[f] ** 2 - d[tuple(sorted((a, b)))] ** 2) / (2 * d[e] * d[f]), -1, 1)
        ok = (radial[e] >= 0) & (radial[f] >= 0) & np.isfinite(cosine)
        index = np.where(ok, radial[e] * n + radial[f], -1)
        moments = [np.where(ok, np.polynomial.polynomial.polyval(np.nan_to_num(cosine), legendre_coefficients(l)), 0) for l in range(max_l + 1)]
        out.append((index, moments))
    return out


def block_sums(g, bins: Bins, xi, kernels, topology: int, draws: int, rng, primaries, max_l: int) -> dict[int, np.ndarray]:
    """Sums by number of points; [r1 r2, l, r3 r4, l']."""
    n, nl = len(bins.edges) ** 2, max_l + 1
    (pair, pair_t), (link, link_t) = kernels
    size = {k: np.zeros((n, nl, n, nl)) for k in (3, 4, 5, 6)}
    own = g.cells[np.searchsorted(g.start, primaries, side="right") - 1]
    pts, cells, prob = [np.repeat(primaries, draws)], [np.repeat(own, draws, axis=0)], np.full(len(primaries) * draws, 1.0)
    for parent, correlated in CHAINS[topology]:
        point, cell, p = sampler.partner(g, cells[parent], link if correlated else pair, link_t if correlated else pair_t, rng)
        ok = point >= 0
        for earlier in pts:
            ok &= point != earlier
        pts, cells = [x[ok] for x in pts] + [point[ok]], [c[ok] for c in cells] + [cell[ok]]
        prob = (prob * p)[ok]
        if len(pts) < 3 or not len(prob):
            continue
        k = len(pts)
        factor, used = FACTORS[k, topology]
        value = factor / prob / draws
        x = lambda a, b: xi(*sampler.geometry_of(g, g.xyz[pts[a]], g.xyz[pts[b]]))
        for a, b in used:
            value = value * x(a, b)
        if (k, topology) in PLUS_ONE:
            c, (a, b) = PLUS_ONE[k, topology]
            value = value * (1 + c * x(a, b))
        for q in range(k):
            value = value * g.w[pts[q]] ** (2 if q < 3 and q in SECOND[k] else 1)
        one = chosen_sides(g, tuple(pts[q] for q in (0, 1, 2)), bins, max_l)
        two = chosen_sides(g, tuple(pts[q] for q in SECOND[k]), bins, max_l)
        for (ia, ma), (ib, mb) in itertools.product(one, two):
            hit = (ia >= 0) & (ib >= 0)
            if not hit.any():
                continue
            for p_, q_ in itertools.product(range(nl), range(nl)):
                np.add.at(size[k][:, p_, :, q_], (ia[hit], ib[hit]), 4 * (value * ma[p_] * mb[q_])[hit])
    return size


def sample(points: DataFrame, bins: Bins, xi, xi_cut: float, cell: float, max_l: int = 2, draws: int = 20, loops: int = 4, seed: int = 1, box: float = 0.0,
           side: int | None = None, sent: int = sampler.SENT) -> DataFrame:
    """term (c3 .. c6), topology, row, col, value; row = (r1 x n_r + r2) x (max_l + 1) + l. Sums are scaled by (2l + 1)(2l' + 1)
    over the shell volumes of all four sides."""
    space = sampler.space_of([points], cell, box)
    reach, far = max(1, int(np.ceil(2 * bins.r_max / cell))), max(1, int(np.ceil(xi_cut / cell)))
    pair, link = sampler.inverse_square_kernel(reach, cell), sampler.correlation_kernel(far, cell, xi.isotropic)
    kernels = ((pair, sampler.alias_table(pair[1])), (link, sampler.alias_table(link[1])))
    halo, nl = 5 * max(reach, far), max_l + 1  # each of five points is drawn from the cell of an earlier one
    side = side or 2 * halo
    volume = np.array([4 * np.pi / 3 * (hi**3 - lo**3) for lo, hi in bins.edges])
    sides = (volume[:, None] * volume[None]).ravel()
    odd = 2 * np.arange(nl) + 1
    scale = odd[None, :, None, None] * odd[None, None, None, :] / (sides[:, None, None, None] * sides[None, None, :, None])

    def run_part(kernels, grids, block, part):
        g, (loop, topology) = grids[1], part
        filled = np.flatnonzero(sampler.block_of(g.cells, side, g.shape) == block)
        own = np.concatenate([np.arange(g.start[f], g.start[f] + g.count[f]) for f in filled]) if len(filled) else np.zeros(0, np.int64)
        rng, total = sampler.rng_of(seed, 2 * loop + topology, block), {}
        for at in range(0, len(own), 4096):
            for k, v in block_sums(g, bins, xi, kernels, topology, draws, rng, own[at : at + 4096], max_l).items():
                total[k] = total[k] + v if k in total else v
        cols: list[list] = [[], [], [], [], []]
        for k, v in total.items():
            flat = (v * scale).reshape(v.shape[0] * nl, -1)
            r, c = np.nonzero(flat)
            for x, got in zip(cols, ([f"c{k}"] * len(r), [topology] * len(r), r, c, flat[r, c]), strict=True):
                x.extend(got)
        types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["term", "topology", "row", "col", "value"])

    parts = [(loop, topology) for loop in range(loops) for topology in (0, 1)]
    sums = sampler.over_blocks({1: points}, space, halo, side, parts, kernels, run_part, "term string, topology int, row int, col int, value double", sent)
    return sums.groupBy("term", "topology", "row", "col").agg((F.sum("value") / loops).alias("value"))
