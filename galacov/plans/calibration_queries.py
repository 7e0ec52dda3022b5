"""Queries of calibration and checks, on covariances of two bins, where SQL has closed forms; and of other last steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from galacov.functions import geometry
from galacov.operators import calibration, multipoles, pairs, terms, triples
from galacov.plans import config, post_process
from galacov.plans import fixtures as fx
from galacov.plans import matrix_queries as mq
from galacov.plans import pair_queries as pq
from galacov.plans import term_queries as tq
from galacov.plans.catalog_queries import rounded
from galacov.plans.registry import query

#: Partial matrices [[a, b], [b, d]] of eight subsamples, and a second set from other rows.
PART = """part AS (SELECT term, k, base + avg(value) FILTER (event_id % 3 = 0) / 64 AS a, avg(value) FILTER (event_id % 3 = 1) / 256 AS b, base + 1 + avg(value) FILTER (event_id % 3 = 2) / 64 AS d
  FROM (SELECT user_id % 8 AS k, event_id, value, ['c2', 'c3', 'c4'][(event_id // 3) % 3 + 1] AS term, [1, 2, 8][(event_id // 3) % 3 + 1] AS base FROM events) GROUP BY term, k, base)"""
FULL = "tot AS (SELECT k, sum(f * a) AS a, sum(f * b) AS b, sum(f * d) AS d FROM (SELECT *, CASE term WHEN 'c4' THEN 1 WHEN 'c3' THEN 1.5 ELSE 2.25 END::DOUBLE AS f FROM part) GROUP BY k)"
ALPHA = 1.5


def partial(spark, sf_dir):
    """term, subsample, row, col, value."""
    e = fx.read(spark, sf_dir, "events")
    kind = F.expr("cast((event_id div 3) % 3 as int)")
    term, base = (F.element_at(F.array(*map(F.lit, v)), kind + 1) for v in (("c2", "c3", "c4"), (1, 2, 8)))
    mean = lambda r: F.avg(F.when(F.col("event_id") % 3 == r, F.col("value")))
    got = e.groupBy(term.alias("term"), (F.col("user_id") % 8).cast("int").alias("subsample"), base.alias("base")).agg(mean(0).alias("x"), mean(1).alias("y"), mean(2).alias("z"))
    cells = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), v.alias("value")) for r, c, v in (
        (0, 0, F.col("base") + F.col("x") / 64), (0, 1, F.col("y") / 256), (1, 0, F.col("y") / 256), (1, 1, F.col("base") + 1 + F.col("z") / 64))])
    return got.select("term", "subsample", F.explode(cells).alias("c")).select("term", "subsample", "c.row", "c.col", "c.value")


def stacks(spark, sf_dir):
    return post_process.matrices(partial(spark, sf_dir), 2)


#: Leave-one-out bias: D = (n - 1) / n (-1 + mean of C_without^-1 C), by entries.
BIAS = """s AS (SELECT count(*) AS n, sum(a) AS a, sum(b) AS b, sum(d) AS d FROM tot),
loo AS (SELECT t.k, s.n, (s.a - t.a) / (s.n - 1) AS p, (s.b - t.b) / (s.n - 1) AS q, (s.d - t.d) / (s.n - 1) AS r, t.a, t.b, t.d FROM tot t, s),
bias AS (SELECT (max(n) - 1)::DOUBLE / max(n) * (avg((r * a - q * b) / (p * r - q * q)) - 1) AS d11, (max(n) - 1)::DOUBLE / max(n) * avg((r * b - q * d) / (p * r - q * q)) AS d12,
  (max(n) - 1)::DOUBLE / max(n) * avg((p * b - q * a) / (p * r - q * q)) AS d21, (max(n) - 1)::DOUBLE / max(n) * (avg((p * d - q * b) / (p * r - q * q)) - 1) AS d22 FROM loo)"""
CELLS = "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) i(\"row\", col)"
AT = lambda a, b, c, d: f"CASE WHEN \"row\" = 0 AND col = 0 THEN {a} WHEN \"row\" = 0 THEN {b} WHEN col = 0 THEN {c} ELSE {d} END"


@query(f"WITH {PART}, {FULL}, {BIAS} SELECT \"row\"::INTEGER AS \"row\", col::INTEGER AS col, round(({AT('d11', 'd12', 'd21', 'd22')}) * 1e6, 4) AS value FROM bias, {CELLS}")
def leave_one_out_bias(spark, sf_dir):
    full, parts = stacks(spark, sf_dir)
    d = calibration.bias_matrix(post_process.assembled(full, parts, ALPHA)[1])
    return rounded(calibration.table(spark, d * 1e6), "value", digits=4)


@query(f"WITH {PART}, {FULL}, {BIAS} SELECT round(CASE WHEN d11 * d22 - d12 * d21 > 0 THEN 3 / sqrt(d11 * d22 - d12 * d21) + 1 ELSE 0 END, 3) AS n_eff FROM bias")
def effective_samples(spark, sf_dir):
    full, parts = stacks(spark, sf_dir)
    n = calibration.effective_samples(calibration.bias_matrix(post_process.assembled(full, parts, ALPHA)[1]))
    return spark.createDataFrame([(round(float(n), 3),)], "n_eff double")


_MEAN = "m AS (SELECT avg(a) AS a, avg(b) AS b, avg(d) AS d FROM tot)"


@query(f"""WITH {PART}, {FULL}, {BIAS}, {_MEAN}, v AS (SELECT a, b, d, d11, d12, d21, d22, a * d - b * b AS x FROM m, bias)
SELECT "row"::INTEGER AS "row", col::INTEGER AS col, round({AT('a', 'b', 'b', 'd')}, 9) AS covariance,
  round({AT('((1 - d11) * d + d12 * b) / x', '(-(1 - d11) * b - d12 * a) / x', '(-d21 * d - (1 - d22) * b) / x', '(d21 * b + (1 - d22) * a) / x')}, 9) AS "precision" FROM v, {CELLS}""")
def post_process_fixed(spark, sf_dir):
    """Covariance and precision of a run with a given rescaling."""
    c = config.RunConfig(bins=pairs.Bins(((1.0, 2.0), (2.0, 3.0)), n_mu=1), loops=8, loops_per_sample=1, alphas=(ALPHA,))
    out = post_process.automatic(partial(spark, sf_dir), c, warn=lambda x: None)
    rows = [(r, k, float(out.full_theory_covariance[r, k]), float(out.full_theory_precision[r, k])) for r in range(2) for k in range(2)]
    return rounded(spark.createDataFrame(rows, "row int, col int, covariance double, precision double"), "covariance", "precision", digits=9)


@query(f"""WITH {PART}, {FULL}, {_MEAN}, t AS (SELECT avg(a) * 1.25 AS a, avg(b) AS b, avg(d) AS d FROM tot),
x AS (SELECT 'forward' AS way, m.a AS a, m.b AS b, m.d AS d, t.a AS e, t.b AS f, t.d AS h FROM m, t UNION ALL SELECT 'backward', t.a, t.b, t.d, m.a, m.b, m.d FROM m, t),
y AS (SELECT way, (d * e - b * f) / (a * d - b * b) AS x11, (d * f - b * h) / (a * d - b * b) AS x12, (a * f - b * e) / (a * d - b * b) AS x21, (a * h - b * f) / (a * d - b * b) AS x22, (e * h - f * f) / (a * d - b * b) AS det FROM x)
SELECT way, round(sqrt(((x11 - 1) * (x11 - 1) + 2 * x12 * x21 + (x22 - 1) * (x22 - 1)) / 2), 9) AS r_inv, round((x11 + x22 - 2 - ln(det)) / 2, 9) AS kl, round((x11 + x22) / 2, 9) AS chi2_red FROM y""")
def compared_covariances(spark, sf_dir):
    full, parts = stacks(spark, sf_dir)
    one = post_process.assembled(full, parts, ALPHA)[0]
    two = one.copy()
    two[0, 0] *= 1.25
    got = calibration.compared(one, two)
    rows = [(way, *[float(got[k][i]) for k in ("r_inv", "kl", "chi2_red")]) for i, way in enumerate(("forward", "backward"))]
    return rounded(spark.createDataFrame(rows, "way string, r_inv double, kl double, chi2_red double"), "r_inv", "kl", "chi2_red", digits=9)


_LOW = lambda a, b, d: f"(({a} + {d}) / 2 - sqrt(({a} - {d}) * ({a} - {d}) / 4 + {b} * {b}))"


@query(f"""WITH {PART}, m AS (SELECT term, avg(a) AS a, avg(b) AS b, avg(d) AS d FROM part GROUP BY term), x AS (SELECT p.a AS a2, p.b AS b2, p.d AS d2, q.a - shift AS a4, q.b AS b4, q.d - shift AS d4, shift FROM m p, m q, (VALUES (0.0::DOUBLE), (8.5::DOUBLE), (9.5::DOUBLE), (20.0::DOUBLE)) s(shift) WHERE p.term = 'c2' AND q.term = 'c4'),
y AS (SELECT *, (d2 * a4 - b2 * b4) / (a2 * d2 - b2 * b2) AS p, (d2 * b4 - b2 * d4) / (a2 * d2 - b2 * b2) AS q, (a2 * b4 - b2 * a4) / (a2 * d2 - b2 * b2) AS r, (a2 * d4 - b2 * b4) / (a2 * d2 - b2 * b2) AS s FROM x)
SELECT shift, {_LOW('a4', 'b4', 'd4')} >= -{_LOW('a2', 'b2', 'd2')} AS lowest, (p + s) / 2 - sqrt((p - s) * (p - s) / 4 + q * r) > -1 AS relative, {_LOW('a4', 'b4', 'd4')} > 0 AS positive FROM y""")
def convergence(spark, sf_dir):
    """Eigenvalue criteria of the 4-point term against the 2-point term, and positive definiteness."""
    full, _ = stacks(spark, sf_dir)
    rows = []
    for shift in (0.0, 8.5, 9.5, 20.0):
        c4 = full["c4"] - shift * np.eye(2)
        got = calibration.converged(full["c2"], c4)
        try:
            calibration.positive_definite(c4)
            positive = True
        except ValueError:
            positive = False
        rows.append((shift, got["lowest"], got["relative"], positive))
    return spark.createDataFrame(rows, "shift double, lowest boolean, relative boolean, positive boolean")


@query("SELECT 1.75::DOUBLE AS alpha")
def rescaling_fit(spark, sf_dir):
    """The rescaling that made a target from the partial matrices' means is found again."""
    full, _ = stacks(spark, sf_dir)
    target = full["c4"] + 1.75 * full["c3"] + 1.75**2 * full["c2"]
    return spark.createDataFrame([(round(float(calibration.fit_alpha(target, full["c2"], full["c3"], full["c4"])), 5),)], "alpha double")


@query("SELECT 12.5::DOUBLE AS alpha")
def rescaling_fit_far(spark, sf_dir):
    """A rescaling far beyond the first range of the search."""
    full, _ = stacks(spark, sf_dir)
    target = full["c4"] + 12.5 * full["c3"] + 12.5**2 * full["c2"]
    return spark.createDataFrame([(round(float(calibration.fit_alpha(target, full["c2"], full["c3"], full["c4"])), 4),)], "alpha double")


@query(f"""WITH {mq.MAT}, {tq.FAC}, t AS (SELECT "row" AS a, col AS b, value AS v FROM mat WHERE "row" < 6 AND col < 6) {tq._projected('t')}""")
def project_jackknife_covariance(spark, sf_dir):
    """A covariance in (s, mu) bins as one of multipoles in the same radial bins."""
    m = mq.matrix(spark, sf_dir).where("row < 6 and col < 6").select(F.col("row").alias("a"), F.col("col").alias("b"), "value")
    return rounded(terms.projected(m, multipoles.mu_factors(spark, tq.B.n_mu, 4), tq.B.n_mu), "value")


_LEG = ("1.0::DOUBLE", "c", "(1.5::DOUBLE * c * c - 0.5::DOUBLE)", "(2.5::DOUBLE * c * c * c - 1.5::DOUBLE * c)", "(4.375::DOUBLE * pow(c, 4) - 3.75::DOUBLE * c * c + 0.375::DOUBLE)",
        "(7.875::DOUBLE * pow(c, 5) - 8.75::DOUBLE * pow(c, 3) + 1.875::DOUBLE * c)", "(14.4375::DOUBLE * pow(c, 6) - 19.6875::DOUBLE * pow(c, 4) + 6.5625::DOUBLE * c * c - 0.3125::DOUBLE)")
_COEF = (1.0, 0.5, -0.25, 0.125, 0.0625, -0.03125, 0.015625)


@query("SELECT event_id AS id, round(" + " + ".join(f"{k}::DOUBLE * {p}" for k, p in zip(_COEF, _LEG)) + ", 9) AS inv_phi FROM (SELECT event_id, (event_id % 257 - 128)::DOUBLE / 128 AS c FROM events)")
def threepcf_correction_eval(spark, sf_dir):
    c = ((F.col("event_id") % 257 - 128) / 128).cast("double")
    found = fx.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), triples.inverse_correction(c, F.array(*map(F.lit, _COEF))).alias("inv_phi"))
    return rounded(found, "inv_phi", digits=9)


_RRR = "rrr AS (SELECT least(event_id % 3, (event_id // 3) % 3)::INTEGER AS r1, greatest(event_id % 3, (event_id // 3) % 3)::INTEGER AS r2, ((event_id // 9) % 8)::INTEGER AS mu_bin, count(*)::DOUBLE / 4 AS rrr FROM events GROUP BY 1, 2, 3)"
_ANTI = {0: "(h - g)", 1: "(h * h - g * g) / 2", 2: "((h * h * h - g * g * g) / 2 - (h - g) / 2)", 3: "((5 * pow(h, 4) - 6 * h * h) / 8 - (5 * pow(g, 4) - 6 * g * g) / 8)"}


@query(f"""WITH {_RRR}, b AS (SELECT * FROM rrr UNION ALL SELECT r2, r1, mu_bin, rrr FROM rrr WHERE r1 <> r2), m AS (SELECT r1, r2, rrr / (16 + r1 + r2 + mu_bin) AS q, -1 + mu_bin / 4.0::DOUBLE AS g, -0.75::DOUBLE + mu_bin / 4.0::DOUBLE AS h FROM b)
SELECT r1, r2, l::INTEGER AS l, round(sum(q * (2 * l + 1) / 2 * (CASE l {' '.join(f'WHEN {k} THEN {v}' for k, v in _ANTI.items())} END)), 9) AS coef FROM m, range(4) t(l) GROUP BY 1, 2, 3""")
def threepcf_correction_moments(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events")
    x, y = F.col("event_id") % 3, F.expr("(event_id div 3) % 3")
    rrr = e.groupBy(F.least(x, y).cast("int").alias("r1"), F.greatest(x, y).cast("int").alias("r2"), F.expr("cast((event_id div 9) % 8 as int)").alias("mu_bin")).agg((F.count("*") / 4).alias("rrr"))
    model = spark.createDataFrame([(a, b, m, 16.0 + a + b + m) for a in range(3) for b in range(3) for m in range(8)], "r1 int, r2 int, mu_bin int, model double")
    return rounded(triples.corrected_moments(rrr, model, 8, 3).withColumn("l", F.col("l").cast("int")), "coef", digits=9)


_T3 = "tm AS (SELECT 'c' || (3 + event_id % 4) AS term, ((event_id // 4) % 2)::INTEGER AS topology, ((event_id // 8) % 8)::INTEGER AS \"row\", ((event_id // 64) % 8)::INTEGER AS col, avg(value) / 7 AS value FROM events GROUP BY 1, 2, 3, 4)"
_SWAP = "((({0} // 2) % 2 * 2 + {0} // 4) * 2 + {0} % 2)"


@query(f"""WITH {_T3}, s AS (SELECT "row" AS r, col AS c, sum(value * CASE term WHEN 'c6' THEN topology WHEN 'c5' THEN 1.25 WHEN 'c4' THEN 1.5625 ELSE 1.953125 END::DOUBLE) AS v FROM tm GROUP BY 1, 2),
i AS (SELECT x AS p, y AS q, v FROM s, LATERAL (SELECT unnest([r, {_SWAP.format('r')}]) AS x), LATERAL (SELECT unnest([c, {_SWAP.format('c')}]) AS y)),
j AS (SELECT p, q, v FROM i UNION ALL SELECT q, p, v FROM i) SELECT p::INTEGER AS "row", q::INTEGER AS col, round(sum(v) / 8, 6) AS value FROM j GROUP BY 1, 2""")
def threepcf_combined_images(spark, sf_dir):
    """Two radial bins and l = 0, 1: eight images, both topologies, a cubic in the rescaling."""
    e = fx.read(spark, sf_dir, "events")
    t = e.groupBy(F.concat(F.lit("c"), (3 + F.col("event_id") % 4).cast("string")).alias("term"), F.expr("cast((event_id div 4) % 2 as int)").alias("topology"), F.expr("cast((event_id div 8) % 8 as int)").alias("row"), F.expr("cast((event_id div 64) % 8 as int)").alias("col")).agg((F.avg("value") / 7).alias("value"))
    return rounded(triples.combined(t, 1.25, 2, 2), "value")
