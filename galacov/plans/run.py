"""A whole run: catalogs and correlation functions in, covariance out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galacov.operators import catalog, jackknife, multipoles, pairs, sampler, terms
from galacov.plans import post_process
from galacov.plans.config import ACCUMULATED, PROJECTED, RunConfig

#: Pairs of tracers in the order of blocks.
PAIRS = ((1, 1), (1, 2), (2, 2))


def chosen(t1: int, t2: int, own: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    return own[t1 - 1], None if t1 == t2 else own[t2 - 1]


def pair_counts(points: DataFrame, config: RunConfig, second: DataFrame | None = None) -> DataFrame:
    """bin, rr of the randoms, of ordered pairs of one catalog or pairs between two; analytic in a periodic box."""
    if config.periodic:
        total = points.agg(F.sum("w")).first()[0]
        other = total if second is None else second.agg(F.sum("w")).first()[0]
        counts = pairs.analytic_rr(points.sparkSession, config.bins, float(np.sqrt(total * other)), config.boxsize)
    else:
        counts = pairs.count(points, second, config.bins).select("r_bin", "mu_bin", F.col("wpairs").alias("rr"))
    return jackknife.flat(counts, config.bins.n_mu).select("bin", "rr")


def jackknife_weights(points: DataFrame, config: RunConfig, second: DataFrame | None = None) -> DataFrame:
    """jack, bin, weight: each region's share of the randoms' pairs."""
    box = config.boxsize or None
    counts = jackknife.pair_counts(points, config.bins, box) if second is None else jackknife.cross_counts(points, second, config.bins, box)
    return jackknife.flat(jackknife.weights(counts), config.bins.n_mu).select("jack", "bin", "weight")


def tensors(weights: dict[tuple[int, int], DataFrame], n: int) -> dict:
    """For each two pairs of tracers their weights [region, bin] and products [bin, bin]."""
    own = {p: sampler.jack_arrays(w, n)[0] for p, w in weights.items()}
    most = max(len(w) for w in own.values())
    own = {p: np.vstack([w, np.zeros((most - len(w), n))]) for p, w in own.items()}
    return {(p, q): (own[p], own[q], own[p].T @ own[q]) for p in own for q in own}


def vector(table: DataFrame, n: int, value: str = "rr") -> np.ndarray:
    out = np.zeros(n)
    for r in table.collect():  # a row a bin
        out[r["bin"]] = r[value]
    return out


def volumes_of(bins: pairs.Bins) -> list[float]:
    return [4 * np.pi / 3 * (hi**3 - lo**3) for lo, hi in bins.edges]


def raw_sums(points: DataFrame, xi, config: RunConfig, cell: float | None = None, second: DataFrame | None = None, jack: dict | None = None, phi: Callable | None = None) -> DataFrame:
    """The sampler's sums for this configuration."""
    own = [points] if second is None else [points, second]
    if cell is None:
        ends = catalog.bounding_box(own).first()
        sizes = tuple(ends[f"{c}_size"] for c in "xyz")
        cell = config.boxsize / config.nside if config.periodic else catalog.cuboid(sizes, catalog.tuned_nside(points, config.nside)[0])[0]
    legendre = None
    if config.mode == ACCUMULATED:
        legendre = (config.max_l, phi or (lambda r, mu: np.ones(len(mu))), volumes_of(config.bins))
    own = [p if "half" in p.columns or not jack else catalog.half(p) for p in own]
    return sampler.sample(own[0], config.bins, xi, config.xi_cut, cell, config.n2, config.n3, config.n4, config.loops, config.loops_per_sample, config.seed, config.boxsize,
                          second=own[1] if second is not None else None, jack=jack, legendre=legendre)


def placed(raw: DataFrame) -> DataFrame:
    """t1 .. t4 of each term instead of those of its combination: c4 as drawn; c3 its repeated point, then the other of
    each pair; c2 its pair. Combinations that draw the same sum are averaged."""
    kind = F.substring("term", 1, 2)
    nothing = F.lit(None).cast("int")
    t = [F.when(kind == "c3", F.col("t2")).otherwise(F.col("t1")), F.when(kind == "c3", F.col("t1")).otherwise(F.col("t2")),
         F.when(kind != "c2", F.col("t3")).otherwise(nothing), F.when(kind == "c4", F.col("t4")).otherwise(nothing)]
    out = raw.where(kind.isin("c2", "c3", "c4")).select(*[c.alias(f"t{k}") for k, c in enumerate(t, 1)], F.struct("t1", "t2", "t3", "t4").alias("of"), "term", "subsample", "row", "col", "value")
    key = ["t1", "t2", "t3", "t4", "term"]
    many = out.groupBy(*key).agg(F.count_distinct("of").alias("many"))
    sums = out.groupBy(*key, "subsample", "row", "col").agg(F.sum("value").alias("value"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    on = same[0] & same[1] & same[2] & same[3] & same[4]
    joined = sums.alias("a").join(F.broadcast(many).alias("b"), on)  # a row for each term and tracers
    return joined.select(*[f"a.{c}" for c in key], "subsample", "row", "col", (F.col("value") / F.col("many")).alias("value"))


def divided(sums: DataFrame, rr: dict[tuple[int, int], np.ndarray], config: RunConfig) -> DataFrame:
    """Terms over the norms of their points and the normalised pair counts of both pairs, which leaves the norm of each
    repeated point; accumulated moments over norms alone. sums: with t1 .. t4 as `placed` gives them, or of one tracer."""
    kind = F.substring("term", 1, 2)
    one = "t1" not in sums.columns
    t = [F.lit(1)] * 4 if one else [F.col(f"t{k}") for k in range(1, 5)]
    norm = lambda c: F.when(c == 1, float(config.norms[0])).otherwise(float(config.norms[-1]))
    if config.mode == ACCUMULATED:
        points = F.when(kind == "c2", norm(t[0]) * norm(t[1])).when(kind == "c3", norm(t[0]) * norm(t[1]) * norm(t[2])).otherwise(norm(t[0]) * norm(t[1]) * norm(t[2]) * norm(t[3]))
        return sums.withColumn("value", F.col("value") / points)
    spark = sums.sparkSession
    table = spark.createDataFrame([(p[0], p[1], i, float(v)) for pair, values in rr.items() for p in {pair, pair[::-1]} for i, v in enumerate(values)], "x int, y int, bin int, rr double")

    def side(name: str, x, y, place: str, frame: DataFrame) -> DataFrame:
        own = F.broadcast(table.select(F.col("x").alias(f"x{name}"), F.col("y").alias(f"y{name}"), F.col("bin").alias(f"b{name}"), F.col("rr").alias(f"r{name}")))  # a row a bin
        return frame.join(own, (x == F.col(f"x{name}")) & (y == F.col(f"y{name}")) & (F.col(place) == F.col(f"b{name}")))

    second = [F.when(kind == "c4", t[2]).otherwise(t[0]), F.when(kind == "c4", t[3]).when(kind == "c3", t[2]).otherwise(t[1])]
    out = side("a", t[0], t[1], "row", sums)
    out = side("b", *second, "col", out)
    left = F.when(kind == "c4", 1.0).when(kind == "c3", norm(t[0])).otherwise(norm(t[0]) * norm(t[1]))
    return out.select(*sums.columns[:-1], (F.col("value") * left / (F.col("ra") * F.col("rb"))).alias("value"))


def projected(out: DataFrame, config: RunConfig) -> DataFrame:
    """Terms in (s, mu) bins as moments."""
    n_mu, n_l = config.bins.n_mu, config.max_l // 2 + 1
    f = multipoles.mu_factors(out.sparkSession, n_mu, config.max_l)
    keyed = out.withColumn("r_a", F.expr(f"cast(row div {n_mu} as int)")).withColumn("ma", F.col("row") % n_mu).withColumn("r_b", F.expr(f"cast(col div {n_mu} as int)")).withColumn("mb", F.col("col") % n_mu)
    keyed = keyed.join(F.broadcast(f.select(F.col("mu_bin").alias("ma"), F.col("l").alias("p"), F.col("factor").alias("fa"))), "ma")
    keyed = keyed.join(F.broadcast(f.select(F.col("mu_bin").alias("mb"), F.col("l").alias("q"), F.col("factor").alias("fb"))), "mb")
    place = lambda r, l: (F.col(r) * n_l + F.col(l) / 2).cast("int")
    keys = [c for c in out.columns if c not in ("row", "col", "value")]
    return keyed.groupBy(*keys, place("r_a", "p").alias("row"), place("r_b", "q").alias("col")).agg(F.sum(F.col("value") * F.col("fa") * F.col("fb")).alias("value"))


def raw_terms(points: DataFrame, xi, config: RunConfig, rr: DataFrame | dict | None = None, cell: float | None = None, second: DataFrame | None = None,
              jack: dict | None = None, phi: Callable | None = None, raw: DataFrame | None = None) -> DataFrame:
    """term, subsample, row, col, value (and t1 .. t4) of the sampled terms, divided by norms and pair counts; projected or
    accumulated in the Legendre modes."""
    raw = raw_sums(points, xi, config, cell, second, jack, phi) if raw is None else raw
    if second is None:
        sums = raw.where(F.col("term").rlike("^c[234]")).select("term", "subsample", "row", "col", "value")
    else:
        sums = placed(raw)
    if config.mode == ACCUMULATED:
        return divided(sums, {}, config)
    n = len(config.bins.edges) * config.bins.n_mu
    tables = rr if isinstance(rr, dict) else {(1, 1): rr} if rr is not None else {}
    own = [points, second]
    found = {p: vector(tables[p] if p in tables else pair_counts(*[chosen(*p, own)[0]], config, chosen(*p, own)[1]), n) for p in (PAIRS if second is not None else PAIRS[:1])}
    out = divided(sums, found, config)
    return projected(out, config) if config.mode == PROJECTED else out


def run(points: DataFrame, xi, config: RunConfig, rr: DataFrame | dict | None = None, data_covariance=None, sample=None, cell: float | None = None,
        second: DataFrame | None = None, phi: Callable | None = None) -> post_process.Result:
    """points: id, x, y, z, w (and jack); weights are normalised first. Two tracers need a second catalog and a correlation
    function for each pair of tracers. With config.jackknife, data_covariance is the data's jackknife covariance (of both
    tracers' auto-correlations, in order, if there are two)."""
    if (second is not None) != (config.tracers == 2):
        raise ValueError("a second catalog goes with two tracers")
    if data_covariance is not None and not config.jackknife:
        raise ValueError("a jackknife covariance goes with jackknife sampling")
    own = [catalog.normalised(p) for p in (points, second) if p is not None]
    n = len(config.bins.edges) * config.bins.n_mu
    jack = None
    if config.jackknife:
        jack = tensors({p: jackknife_weights(chosen(*p, own)[0], config, chosen(*p, own)[1]) for p in (PAIRS if second is not None else PAIRS[:1])}, n)
    other = own[1] if second is not None else None
    raw = raw_sums(own[0], xi, config, cell, other, jack, phi).persist()
    found = raw_terms(own[0], xi, config, rr, None, other, jack, phi, raw).persist()
    try:
        extra = None
        if config.jackknife and config.mode != PROJECTED and data_covariance is not None:
            tables = rr if isinstance(rr, dict) else {(1, 1): rr} if rr is not None else {}
            count = lambda p: vector(tables[p] if p in tables else pair_counts(chosen(*p, own)[0], config, chosen(*p, own)[1]), n)
            extra = {t: post_process.disconnected(raw if second is None else raw.where(f"t1 = {t} and t2 = {t} and t3 = {t} and t4 = {t}"), count((t, t)), jack[(t, t), (t, t)][2], config) for t in range(1, config.tracers + 1)}
        if second is not None:
            return post_process.two_tracers(found, config, data_covariance, extra)
        return post_process.automatic(found, config, data_covariance, sample, extra[1] if extra else None)
    finally:
        found.unpersist()
        raw.unpersist()


def exact_terms(points: DataFrame, xi, config: RunConfig) -> DataFrame:
    """term, subsample (0), row, col, value by joins, for sparse catalogs."""
    leg = terms.legs(points, config.bins, xi, config.boxsize or None)
    link = terms.links(points, config.xi_cut, xi, config.boxsize or None)
    rr, norm = pair_counts(points, config), config.norms[0]
    two = terms.divided(terms.c2(leg), rr, norm, 2).select(F.lit("c2").alias("term"), F.col("a").alias("row"), F.col("a").alias("col"), "value")
    out = two
    for name, t, k in (("c3", terms.c3(leg, link), 3), ("c4", terms.c4(leg, link), 4)):
        out = out.unionByName(terms.divided(t, rr, norm, k).select(F.lit(name).alias("term"), F.col("a").alias("row"), F.col("b").alias("col"), "value"))
    return out.withColumn("subsample", F.lit(0))
