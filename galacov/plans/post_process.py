"""From raw terms to a covariance: fixed, jackknife- or mock-calibrated shot-noise rescaling, precision and checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galacov.operators import calibration, covariance
from galacov.plans.config import S_MU, RunConfig


@dataclass
class Result:
    full_theory_covariance: np.ndarray
    full_theory_precision: np.ndarray
    full_theory_D_matrix: np.ndarray
    N_eff: float
    shot_noise_rescaling: tuple[float, ...]
    individual_theory_covariances: np.ndarray
    jackknife_data_covariance: np.ndarray | None = None
    jackknife_theory_covariance: np.ndarray | None = None

    def table(self, spark) -> DataFrame:
        """The covariance as (row, col, value)."""
        return calibration.table(spark, self.full_theory_covariance)

    def save(self, path: str) -> None:
        """npz; an existing file is an error."""
        import os

        if os.path.exists(path):
            raise FileExistsError(path)
        np.savez(path, **{k: v for k, v in vars(self).items() if v is not None})


def selected(terms: DataFrame, config: RunConfig) -> DataFrame:
    """Bins that stay; Legendre bins in the order (l, r)."""
    n_r, inner = len(config.bins.edges), config.bins.n_mu if config.mode == S_MU else config.max_l // 2 + 1
    keep = inner - (config.skip_l if config.mode != S_MU else 0)
    parts = covariance.kept_bins(terms, n_r, inner, config.skip_r_bins, keep, inner_first=config.mode != S_MU)
    return covariance.symmetrised(parts, [c for c in ("term", "subsample") if c in terms.columns])


def matrices(terms: DataFrame, n: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Full matrices by term, and stacks by subsample. terms: (term, subsample, row, col, value); one collect of as many
    rows as the matrices have entries."""
    got = terms.select("term", "subsample", "row", "col", "value").toArrow()
    term, sub, r, c, v = (got.column(i).to_numpy(zero_copy_only=False) for i in range(5))
    samples = np.unique(sub)
    place = {s: i for i, s in enumerate(samples)}
    parts = {}
    for name in np.unique(term.astype(str)):
        own = np.zeros((len(samples), n, n))
        at = term == name
        own[np.array([place[s] for s in sub[at]], dtype=int), r[at], c[at]] = v[at]
        parts[str(name)] = own
    return {k: p.mean(axis=0) for k, p in parts.items()}, parts


def assembled(full: dict[str, np.ndarray], parts: dict[str, np.ndarray], alpha: float, suffix: str = "") -> tuple[np.ndarray, np.ndarray]:
    power = ((f"c4{suffix}", 1.0), (f"c3{suffix}", alpha), (f"c2{suffix}", alpha**2))
    return sum(full[k] * a for k, a in power), sum(parts[k] * a for k, a in power)


def finished(full: np.ndarray, parts: np.ndarray, alphas: tuple[float, ...], warn=print, c2: np.ndarray | None = None, c4: np.ndarray | None = None) -> Result:
    calibration.positive_definite(full)
    if c2 is not None and not all(calibration.converged(c2, c4, alphas[0]).values()):
        warn("the 4-point term has not converged")
    d, psi = calibration.precision(parts, full)
    return Result(full, psi, d, calibration.effective_samples(d), alphas, parts)


def fixed(terms: DataFrame, config: RunConfig, warn=print) -> Result:
    """One tracer, the rescaling as given. terms: (term, subsample, row, col, value), divided by pair counts."""
    n = kept_size(config)
    full, parts = matrices(selected(terms, config), n)
    return finished(*assembled(full, parts, config.alphas[0]), config.alphas, warn, full["c2"], full["c4"])


def kept_size(config: RunConfig) -> int:
    inner = config.bins.n_mu if config.mode == S_MU else config.max_l // 2 + 1 - config.skip_l
    return (len(config.bins.edges) - sum(config.skip_r_bins)) * inner


def from_mocks(terms: DataFrame, sample: np.ndarray, config: RunConfig, warn=print) -> Result:
    """The rescaling is fitted to a sample covariance."""
    full, parts = matrices(selected(terms, config), kept_size(config))
    alpha = calibration.fit_alpha(sample, full["c2"], full["c3"], full["c4"], (parts["c2"], parts["c3"], parts["c4"]))
    return finished(*assembled(full, parts, alpha), (alpha,), warn, full["c2"], full["c4"])


def from_jackknife(terms: DataFrame, data_covariance: np.ndarray, config: RunConfig, disconnected: np.ndarray | None = None, warn=print) -> Result:
    """The rescaling is fitted to the jackknife covariance of the data with the jackknife terms c2j, c3j, c4j."""
    full, parts = matrices(selected(terms, config), kept_size(config))
    if disconnected is not None:  # of the whole, or by subsample
        own = np.broadcast_to(disconnected, parts["c4j"].shape)
        full["c4j"], parts["c4j"] = full["c4j"] + own.mean(axis=0), parts["c4j"] + own
    alpha = calibration.fit_alpha(data_covariance, full["c2j"], full["c3j"], full["c4j"], (parts["c2j"], parts["c3j"], parts["c4j"]))
    out = finished(*assembled(full, parts, alpha), (alpha,), warn, full["c2"], full["c4"])
    out.jackknife_data_covariance = data_covariance
    out.jackknife_theory_covariance = assembled(full, parts, alpha, "j")[0]
    return out


#: Orders of a term's points that leave its sum the same, and whether the two pairs change places: c2 (X, Y), c3 (the
#: repeated point, then the other of each pair), c4 (two pairs).
IMAGES = {"c2": [((0, 1), False), ((1, 0), False)], "c3": [((0, 1, 2), False), ((0, 2, 1), True)],
          "c4": [((*p, *q), False) for p in ((0, 1), (1, 0)) for q in ((2, 3), (3, 2))] + [((*q, *p), True) for p in ((0, 1), (1, 0)) for q in ((2, 3), (3, 2))]}


def disconnected(raw: DataFrame, rr: np.ndarray, products: np.ndarray, config: RunConfig) -> np.ndarray:
    """The disconnected part of the jackknife 4-point term by subsample, from the sums rr1, ee1, rr2, ee2 by region:
    sum_A (EE1_aA - w1_aA EE1_a)(EE2_bA - w2_bA EE2_b) / (RR_a RR_b (1 - sum_A w_aA w_bA)), the mean of both ways to take
    the halves. Regions x bins rows for each subsample come to the driver."""
    got = raw.where(F.col("term").isin("rr1", "ee1", "rr2", "ee2")).groupBy("term", "subsample", "row", "col").agg(F.avg("value").alias("value")).toArrow()
    term, sub, row, col, value = (got.column(i).to_numpy(zero_copy_only=False) for i in range(5))
    n_sub, regions, n = int(sub.max()) + 1 if len(sub) else 1, int(row.max()) + 1 if len(row) else 1, len(rr)
    sums = {}
    for name in ("rr1", "ee1", "rr2", "ee2"):
        sums[name] = np.zeros((n_sub, regions, n))
        at = term.astype(str) == name
        sums[name][sub[at], row[at], col[at]] = value[at]

    def left(h: int) -> np.ndarray:
        total = sums[f"rr{h}"].sum(axis=1, keepdims=True)
        share = np.divide(sums[f"rr{h}"], total, out=np.zeros_like(sums[f"rr{h}"]), where=total != 0)
        return sums[f"ee{h}"] - share * sums[f"ee{h}"].sum(axis=1, keepdims=True)

    one = np.einsum("sja,sjb->sab", left(1), left(2)) / (rr[:, None] * rr[None] * (1 - products))
    keep = kept_places(config)
    return ((one + one.transpose(0, 2, 1)) / 2)[:, keep][:, :, keep]


def kept_places(config: RunConfig) -> np.ndarray:
    """Bins (r, mu) that stay."""
    n_r, m, (first, last) = len(config.bins.edges), config.bins.n_mu, config.skip_r_bins
    return (np.arange(first, n_r - last)[:, None] * m + np.arange(m)).ravel()


def tracer_matrices(terms: DataFrame, config: RunConfig) -> dict[tuple, np.ndarray]:
    """Stacks by subsample of each term and tracers, (c2, X, Y), (c3, X, Y, Z) with X repeated, (c4, X, Y, Z, W), with all
    images under their symmetries averaged in. One collect of as many rows as the matrices have entries."""
    n_r, inner = len(config.bins.edges), config.bins.n_mu if config.mode == S_MU else config.max_l // 2 + 1
    keep = inner - (config.skip_l if config.mode != S_MU else 0)
    parts = covariance.kept_bins(terms, n_r, inner, config.skip_r_bins, keep, inner_first=config.mode != S_MU)
    n = kept_size(config)
    got = parts.select("term", "t1", "t2", "t3", "t4", "subsample", "row", "col", "value").toPandas()
    samples = np.unique(got["subsample"])
    images: dict[tuple, list] = {}
    for key, rows in got.groupby(["term", "t1", "t2", "t3", "t4"], dropna=False):
        own = np.zeros((len(samples), n, n))
        own[np.searchsorted(samples, rows["subsample"]), rows["row"], rows["col"]] = rows["value"]
        t = [int(x) for x in key[1:] if x == x]
        for order, turned in IMAGES[key[0][:2]]:
            images.setdefault((key[0], *(t[i] for i in order)), []).append(own.transpose(0, 2, 1) if turned else own)
    return {k: np.mean(v, axis=0) for k, v in images.items()}


def blocks_of(parts: dict[tuple, np.ndarray], alphas: Sequence[float], suffix: str = "") -> np.ndarray:
    """Stacks of the covariance of (11, 12, 22): for pairs XY and ZW
    C4_XYZW + a_X/4 (d_XW C3_X,YZ + d_XZ C3_X,YW) + a_Y/4 (d_YW C3_Y,XZ + d_YZ C3_Y,XW) + a_X a_Y/2 (d_XW d_YZ + d_XZ d_YW) C2_XY."""
    order, rows = ((1, 1), (1, 2), (2, 2)), []
    three = lambda r, p, q: parts[f"c3{suffix}", r, p, q]
    for x, y in order:
        line = []
        for z, w in order:
            c = parts[f"c4{suffix}", x, y, z, w].copy()
            ax, ay = alphas[x - 1] / 4, alphas[y - 1] / 4
            for hit, a, r, p, q in ((x == w, ax, x, y, z), (x == z, ax, x, y, w), (y == w, ay, y, x, z), (y == z, ay, y, x, w)):
                if hit:
                    c += a * three(r, p, q)
            c += alphas[x - 1] * alphas[y - 1] / 2 * ((x == w) * (y == z) + (x == z) * (y == w)) * parts[f"c2{suffix}", x, y]
            line.append(c)
        rows.append(np.concatenate(line, axis=2))
    out = np.concatenate(rows, axis=1)
    return (out + out.transpose(0, 2, 1)) / 2


def two_tracers(terms: DataFrame, config: RunConfig, data_covariances: Sequence[np.ndarray] | None = None, extra: dict | None = None, warn=print) -> Result:
    """The covariance of (11, 12, 22). terms: (t1 .. t4, term, subsample, row, col, value), divided by pair counts.
    data_covariances: jackknife covariances of both tracers' auto-correlations, to which each rescaling is fitted with the
    jackknife terms; extra: the disconnected parts by tracer."""
    parts = tracer_matrices(terms, config)
    alphas = list(config.alphas)
    if data_covariances is not None:
        for t in (1, 2):
            own = [parts["c2j", t, t], parts["c3j", t, t, t], parts["c4j", t, t, t, t]]
            own = [(m + m.transpose(0, 2, 1)) / 2 for m in own]
            if extra:
                own[2] = own[2] + extra[t]
            alphas[t - 1] = calibration.fit_alpha(data_covariances[t - 1], *[m.mean(axis=0) for m in own], tuple(own))
    stack = blocks_of(parts, alphas)
    out = finished(stack.mean(axis=0), stack, tuple(alphas), warn)
    if data_covariances is not None:
        out.jackknife_theory_covariance = blocks_of(parts, alphas, "j").mean(axis=0)
    return out


def automatic(terms: DataFrame, config: RunConfig, data_covariance: np.ndarray | None = None, sample: np.ndarray | None = None, disconnected: np.ndarray | None = None,
              dry_run: bool = False, warn=print):
    """The calibration that the inputs call for: mocks before jackknife before a fixed rescaling. dry_run: its name."""
    names = {r["term"] for r in terms.select("term").distinct().collect()}
    if sample is not None:
        kind = "mocks"
    elif data_covariance is not None:
        if not {"c2j", "c3j", "c4j"} <= names:
            raise ValueError("a jackknife calibration needs the terms c2j, c3j and c4j")
        kind = "jackknife"
    else:
        kind = "fixed"
    if dry_run:
        return kind
    if kind == "mocks":
        return from_mocks(terms, sample, config, warn)
    if kind == "jackknife":
        return from_jackknife(terms, data_covariance, config, disconnected, warn)
    return fixed(terms, config, warn)


def split_half_check(terms: DataFrame, config: RunConfig, alpha: float) -> dict[str, dict[str, tuple[float, float]]]:
    """R_inv, D_KL and reduced chi^2 between covariances of halves of the subsamples, first and second and odd and even."""
    n_samples = terms.agg(F.max("subsample")).first()[0] + 1
    n, out = kept_size(config), {}
    chosen = selected(terms.where(F.col("term").isin("c2", "c3", "c4")), config)
    for name, alternate in (("halves", False), ("odd_even", True)):
        parts = covariance.halves(chosen, n_samples // 2 * 2, alternate)
        both = [calibration.matrix(covariance.combined_alpha(parts.where(F.col("half") == h), alpha), n) for h in (0, 1)]
        out[name] = calibration.compared(*both)
    return out
