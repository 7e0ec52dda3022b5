"""Queries of the sampled plan; numeric results are tested against the exact terms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from galacov.functions.interpolation import CorrelationFunction
from galacov.operators import calibration, covariance, refinement, sampler
from galacov.plans import fixtures as fx
from galacov.plans.registry import query


def xi_table() -> CorrelationFunction:
    r = np.arange(2.0, 82.0, 2.0)
    mu = np.linspace(0.05, 0.95, 10)
    return CorrelationFunction(r, mu, np.repeat((fx.XI_AMPLITUDE / r**2)[:, None], len(mu), axis=1))


@query()
def sampled_c2c3c4(spark, sf_dir):
    return sampler.sample(fx.points(spark, sf_dir), fx.BINS, xi_table(), fx.XI_CUT, cell=20.0, loops=16, loops_per_sample=4)


@query()
def sampled_covariance(spark, sf_dir):
    """C4 + alpha C3 + alpha^2 C2 of the sampled sums, symmetrised."""
    raw = sampler.sample(fx.points(spark, sf_dir), fx.BINS, xi_table(), fx.XI_CUT, cell=20.0, loops=16, loops_per_sample=4)
    terms = covariance.full(raw.where(F.col("term").isin("c2", "c3", "c4")))
    return covariance.symmetrised(covariance.combined_alpha(terms, 1.0))


@query()
def sampled_jackknife_terms(spark, sf_dir):
    """c2j, c3j, c4j and the halves' counts by region, beside the plain terms."""
    from galacov.plans import pair_queries as pq

    weight = pq.weights(spark, sf_dir).select("jack", "bin", "weight")
    w, product = sampler.jack_arrays(weight, len(fx.BINS.edges) * fx.BINS.n_mu)
    return sampler.sample(fx.points(spark, sf_dir), fx.BINS, xi_table(), fx.XI_CUT, cell=20.0, loops=16, loops_per_sample=4, jack={((1, 1), (1, 1)): (w, w, product)})


@query()
def sampled_two_tracers(spark, sf_dir):
    """The seven combinations of two catalogs."""
    p = fx.points(spark, sf_dir)
    return sampler.sample(p.where("tracer = 1"), fx.BINS, {k: xi_table() for k in ((1, 1), (1, 2), (2, 2))}, fx.XI_CUT, cell=20.0, loops=8, loops_per_sample=2, second=p.where("tracer = 2"))


@query()
def sampled_moments(spark, sf_dir):
    """Accumulated Legendre moments up to l = 4."""
    volumes = [4 * np.pi / 3 * (hi**3 - lo**3) for lo, hi in fx.BINS.edges]
    return sampler.sample(fx.points(spark, sf_dir), fx.BINS, xi_table(), fx.XI_CUT, cell=20.0, loops=16, loops_per_sample=4, legendre=(4, lambda r, mu: np.ones(len(mu)), volumes))


@query()
def sampled_by_blocks(spark, sf_dir):
    """The plan for catalogs that are too large to be sent whole: blocks of cells with their halos."""
    return sampler.sample(fx.points(spark, sf_dir), fx.BINS, xi_table(), fx.XI_CUT, cell=20.0, loops=4, loops_per_sample=2, side=8, sent=0)


_K = sampler.inverse_square_kernel(1, 50.0)
_EDGE = np.floor(np.cumsum(_K[1]) * 2**32).astype(np.int64)
_EDGE[-1] = 2**32
_STEPS = ", ".join(f"({lo}, {hi}, {x}, {y}, {z})" for lo, hi, (x, y, z) in zip(np.concatenate([[0], _EDGE[:-1]]).tolist(), _EDGE.tolist(), _K[0].tolist(), strict=True) if hi > lo)
_CEL = "cel AS (SELECT id, floor(x / 50)::BIGINT AS cx, floor(y / 50)::BIGINT AS cy, floor(z / 50)::BIGINT AS cz FROM pts)"
_U = lambda k: f"('0x' || substr(md5('draw-{k}|' || cel.id || '-' || d.i), 1, 8))::BIGINT"


@query(f"""WITH {fx.PTS}, {_CEL}, st(lo, hi, dx, dy, dz) AS (VALUES {_STEPS}),
nm AS (SELECT *, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY cx, cy, cz) AS np FROM cel),
dr AS (SELECT cel.*, d.i AS draw, {_U('o')} AS u, {_U('p')} AS v FROM cel, range(4) d(i))
SELECT dr.id AS id1, dr.draw::INTEGER AS draw, nm.id AS id2 FROM dr JOIN st ON dr.u >= st.lo AND dr.u < st.hi JOIN nm ON nm.cx = dr.cx + st.dx AND nm.cy = dr.cy + st.dy AND nm.cz = dr.cz + st.dz AND nm.pos = floor(dr.v * nm.np / 4294967296.0::DOUBLE)""")
def sampled_pairs_md5(spark, sf_dir):
    return sampler.pair_draws(fx.points(spark, sf_dir), 4, 50.0, 1)


@query()
def refined_xi(spark, sf_dir):
    """r, mu, xi at the centres of bins, from bin averages."""
    target = np.array([[1.2, 1.0, 0.8], [0.5, 0.4, 0.3]])
    found = refinement.refined(fx.points(spark, sf_dir), fx.BINS, target)
    rows = [(float(r), float(m), float(found.xi[i, j])) for i, r in enumerate(found.r) for j, m in enumerate(found.mu)]
    return spark.createDataFrame(rows, "r double, mu double, xi double")


@query()
def shot_noise_fit(spark, sf_dir):
    """alpha, objective: fitted to a target made with alpha = 1.25 from the exact terms' matrices."""
    from galacov.operators import terms
    from galacov.plans import term_queries as tq

    rr = tq.rr(spark, sf_dir)
    n = len(fx.BINS.edges) * fx.BINS.n_mu
    two = terms.divided(tq.c2(spark, sf_dir), rr, fx.NORM, 2)
    c2 = calibration.matrix(two.select(F.col("a").alias("row"), F.col("a").alias("col"), "value"), n)
    c3 = calibration.matrix(terms.divided(tq.c3(spark, sf_dir), rr, fx.NORM, 3).toDF("row", "col", "value"), n)
    c4 = calibration.matrix(terms.divided(tq.c4(spark, sf_dir), rr, fx.NORM, 4).toDF("row", "col", "value"), n)
    c2, c3, c4 = ((m + m.T) / 2 for m in (c2, c3, c4))
    lift = max(0.0, -np.linalg.eigvalsh(c4 + c3).min()) * 2
    c4 = c4 + lift * np.eye(n)  # a small catalog's noise may leave the sum indefinite
    target = c4 + 1.25 * c3 + 1.5625 * c2
    alpha = calibration.fit_alpha(target, c2, c3, c4)
    return spark.createDataFrame([(float(alpha), calibration.negative_likelihood(target, np.linalg.inv(c4 + alpha * c3 + alpha**2 * c2)))], "alpha double, objective double")


@query()
def xi_interpolated(spark, sf_dir):
    """id1, id2, xi of all pairs within the cutoff, from the table."""
    from galacov.operators import pairs

    p = fx.points(spark, sf_dir)
    met = pairs.pairs(p, p, fx.XI_CUT, same=True, ordered=False)
    return met.select("id1", "id2", xi_table().column(F.col("s"), F.col("mu")).alias("xi"))


@query()
def threepcf_sampled(spark, sf_dir):
    """C3 to C6 from both topologies."""
    from galacov.operators import sampler3

    return sampler3.sample(fx.points(spark, sf_dir), fx.BINS, xi_table(), fx.XI_CUT, cell=20.0, max_l=1, draws=20, loops=4)


@query()
def threepcf_covariance(spark, sf_dir):
    from galacov.operators import sampler3, triples

    return triples.combined(sampler3.sample(fx.points(spark, sf_dir), fx.BINS, xi_table(), fx.XI_CUT, cell=20.0, max_l=1, draws=20, loops=4), 1.0, len(fx.BINS.edges), 2)


@query()
def power_c2(spark, sf_dir):
    from galacov.operators import power, tuples
    from galacov.plans import term_queries as tq

    leg = tq.power_leg(2, None)
    return power.placed(tuples.spread(tuples.two(fx.points(spark, sf_dir), leg, fx.xi), leg.n), 2)


@query()
def survey_correction_fit(spark, sf_dir):
    """Of uniform points, as many as the catalog has: away from the edges the correction is near 1."""
    from galacov.operators import catalog, correction, pairs

    n = min(4000, 4 * fx.points(spark, sf_dir).count())
    p = catalog.uniform_points(spark, n, 400.0).withColumn("w", F.lit(1.0))
    bins = pairs.Bins(fx.BINS.edges, n_mu=6)
    counts = pairs.count(p, None, bins).withColumnRenamed("wpairs", "rr")
    return correction.fitted(counts, bins, correction.density(p, float(p.count())))


@query()
def hull_volume(spark, sf_dir):
    from galacov.operators import correction

    v = correction.hull_volume(correction.extremes(fx.points(spark, sf_dir)))
    return spark.createDataFrame([(float(v),)], "volume double")
