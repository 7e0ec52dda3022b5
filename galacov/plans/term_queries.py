"""Queries of the exact covariance terms. They run over the whole catalog; points are sparse for the bins used here."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from galacov.functions import geometry
from galacov.operators import jackknife, multipoles, pairs, power, terms, triples, tuples
from galacov.plans import fixtures as fx
from galacov.plans import pair_queries as pq
from galacov.plans.catalog_queries import rounded
from galacov.plans.registry import query

B = fx.BINS
XI = f"({fx.XI_AMPLITUDE} / (s * s))"
LEG = f"""{fx.pairs_sql('pr', 'pts', 'pts', B.r_min, B.r_max)}, {fx.binned_sql('bp', 'pr')}, {fx.pairs_sql('lk0', 'pts', 'pts', 0, fx.XI_CUT)},
leg AS (SELECT id1 AS i, id2 AS j, bin AS a, r_bin, mu, w1 AS wi, w2 AS wj, jack1 AS ji, jack2 AS jj, {XI} AS xi FROM bp), lnk AS (SELECT id1 AS i, id2 AS k, {XI} AS x FROM lk0),
rb AS (SELECT bin, sum(w1 * w2) / {fx.NORM ** 2} AS rr FROM bp GROUP BY bin)"""
TRI = "tri AS (SELECT p.a, q.a AS b, p.r_bin, q.r_bin AS r_b, p.mu, q.mu AS mu_b, p.wi, p.wj, q.wj AS wk, p.ji, p.jj, q.jj AS jk, x FROM leg p JOIN lnk ON p.i = lnk.i JOIN leg q ON q.i = p.j AND q.j = lnk.k WHERE p.i <> lnk.k)"
QUAD = """quad AS (SELECT p.a, q.a AS b, p.r_bin, q.r_bin AS r_b, p.mu, q.mu AS mu_b, p.wi, p.wj, q.wi AS wk, q.wj AS wl, p.ji, p.jj, q.ji AS jk, q.jj AS jl, u.x, v.x AS y
  FROM leg p JOIN lnk u ON p.i = u.i JOIN lnk v ON p.j = v.i JOIN leg q ON q.i = u.k AND q.j = v.k WHERE u.k <> p.j AND v.k <> p.i AND v.k <> u.k)"""
DIV = lambda n, a="t.a", b="t.b": f"/ ({fx.NORM ** n} * x.rr * y.rr)"
JOINED = "JOIN rb x ON t.a = x.bin JOIN rb y ON t.b = y.bin"


BINNED = tuples.binned(B)


def legs(spark, sf_dir):
    return terms.legs(fx.points(spark, sf_dir), B, fx.xi)


def rr(spark, sf_dir):
    return jackknife.flat(pairs.count(fx.points(spark, sf_dir), None, B), B.n_mu).select("bin", F.col("wpairs").alias("rr"))


def c2(spark, sf_dir):
    return tuples.two(fx.points(spark, sf_dir), BINNED, fx.xi).select(F.col("g").alias("a"), F.col("v0").alias("value"))


def c3(spark, sf_dir, leg=BINNED):
    return tuples.three(fx.points(spark, sf_dir), leg, fx.XI_CUT, fx.xi, isotropic=True)


def c4(spark, sf_dir, leg=BINNED):
    return tuples.four(fx.points(spark, sf_dir), leg, fx.XI_CUT, fx.xi, isotropic=True)


@query(f"WITH {fx.PTS}, {LEG}, t AS (SELECT a, a AS b, 2 * sum(wi * wi * wj * wj * (1 + xi)) AS v FROM leg GROUP BY a) SELECT t.a, round(v {DIV(2)}, 9) AS value FROM t {JOINED}")
def c2_exact(spark, sf_dir):
    return rounded(terms.divided(c2(spark, sf_dir), rr(spark, sf_dir), fx.NORM, 2), "value", digits=9)


@query(f"WITH {fx.PTS}, {LEG}, {TRI}, t AS (SELECT a, b, 4 * sum(wi * wj * wj * wk * x) AS v FROM tri GROUP BY a, b) SELECT t.a, t.b, round(v {DIV(3)}, 9) AS value FROM t {JOINED}")
def c3_exact(spark, sf_dir):
    return rounded(terms.divided(c3(spark, sf_dir), rr(spark, sf_dir), fx.NORM, 3), "value", digits=9)


@query(f"WITH {fx.PTS}, {LEG}, {QUAD}, t AS (SELECT a, b, 2 * sum(wi * wj * wk * wl * x * y) AS v FROM quad GROUP BY a, b) SELECT t.a, t.b, round(v {DIV(4)}, 9) AS value FROM t {JOINED}")
def c4_exact(spark, sf_dir):
    return rounded(terms.divided(c4(spark, sf_dir), rr(spark, sf_dir), fx.NORM, 4), "value", digits=9)


JP = pq.JP.replace(pq.RR + ", ", "")


def q_sql(source: str, roles: tuple[str, str, str, str]) -> str:
    ji, jj, jk, jl = roles
    hit = lambda a, b: f"CASE WHEN t.{a} = t.{b} THEN 1 ELSE 0 END"
    return f"""SELECT t.*, (0.25::DOUBLE * ({hit(ji, jk)} + {hit(jj, jk)} + {hit(ji, jl)} + {hit(jj, jl)}) - 0.5::DOUBLE * (coalesce(w0.weight, 0) + coalesce(w1.weight, 0) + coalesce(w2.weight, 0) + coalesce(w3.weight, 0)) + jp.value) / (1 - jp.value) AS q
  FROM {source} t JOIN jp ON t.a = jp.bin_a AND t.b = jp.bin_b LEFT JOIN jw w0 ON w0.jack = t.{ji} AND w0.bin = t.b LEFT JOIN jw w1 ON w1.jack = t.{jj} AND w1.bin = t.b
  LEFT JOIN jw w2 ON w2.jack = t.{jk} AND w2.bin = t.a LEFT JOIN jw w3 ON w3.jack = t.{jl} AND w3.bin = t.a"""


def jack_parts(spark, sf_dir):
    """The points, and weights and their products: regions x bins rows, counted once."""
    w = pq.weights(spark, sf_dir).select("jack", "bin", "weight")
    w = spark.createDataFrame(w.collect(), w.schema)
    return fx.points(spark, sf_dir), w, jackknife.product_weights(w)


@query(f"WITH {fx.PTS}, {LEG}, {JP}, l2 AS (SELECT *, a AS b FROM leg), z AS ({q_sql('l2', ('ji', 'jj', 'ji', 'jj'))}) SELECT a, round(2 * sum(wi * wi * wj * wj * (1 + xi) * q), 6) AS value FROM z GROUP BY a")
def c2_jack(spark, sf_dir):
    points, w, p = jack_parts(spark, sf_dir)
    sums = tuples.two(points, BINNED, fx.xi, regions=True).select(F.col("g").alias("a"), F.col("g").alias("b"), "jack_i", "jack_j", "v0")
    t = terms.with_tensor(sums, ("jack_i", "jack_j", "jack_i", "jack_j"), w, p)  # the weight depends on regions and bins only
    return rounded(t.groupBy("a").agg(F.sum(F.col("v0") * F.col("q")).alias("value")), "value")


@query(f"WITH {fx.PTS}, {LEG}, {JP}, {TRI}, z AS ({q_sql('tri', ('ji', 'jj', 'jj', 'jk'))}) SELECT a, b, round(4 * sum(wi * wj * wj * wk * x * q), 6) AS value FROM z GROUP BY a, b")
def c3_jack(spark, sf_dir):
    points, w, p = jack_parts(spark, sf_dir)
    sums = tuples.sums(points, BINNED, fx.XI_CUT, fx.xi, False, isotropic=True, regions=True)
    return rounded(tuples.jackknifed(sums, w, p, False), "value")


@query(f"WITH {fx.PTS}, {LEG}, {JP}, {QUAD}, z AS ({q_sql('quad', ('ji', 'jj', 'jk', 'jl'))}) SELECT a, b, round(2 * sum(wi * wj * wk * wl * x * y * q), 6) AS value FROM z GROUP BY a, b")
def c4_jack(spark, sf_dir):
    points, w, p = jack_parts(spark, sf_dir)
    sums = tuples.sums(points, BINNED, fx.XI_CUT, fx.xi, True, isotropic=True, regions=True)
    return rounded(tuples.jackknifed(sums, w, p, True), "value")


FAC = f"f AS ({pq.factors_sql(B.n_mu)})"


def _projected(t: str) -> str:
    return f"SELECT (a // {B.n_mu})::INTEGER AS r_a, x.l AS p, (b // {B.n_mu})::INTEGER AS r_b, y.l AS q, round(sum(v * x.factor * y.factor), 6) AS value FROM {t} t JOIN f x ON t.a % {B.n_mu} = x.mu_bin JOIN f y ON t.b % {B.n_mu} = y.mu_bin GROUP BY 1, 2, 3, 4"


@query(f"WITH {fx.PTS}, {LEG}, {FAC}, t AS (SELECT a, a AS b, 2 * sum(wi * wi * wj * wj * (1 + xi)) AS v FROM leg GROUP BY a) {_projected('t')}")
def c2_legendre_projected(spark, sf_dir):
    return rounded(terms.projected(c2(spark, sf_dir), multipoles.mu_factors(spark, B.n_mu, 4), B.n_mu), "value")


@query(f"WITH {fx.PTS}, {LEG}, {TRI}, {FAC}, t AS (SELECT a, b, 4 * sum(wi * wj * wj * wk * x) AS v FROM tri GROUP BY a, b) {_projected('t')}")
def c3_legendre_projected(spark, sf_dir):
    return rounded(terms.projected(c3(spark, sf_dir), multipoles.mu_factors(spark, B.n_mu, 4), B.n_mu), "value")


COEF = (1.0, 0.25, -0.125, 1.125, -0.0625, 0.03125, 0.015625)
PHI_SQL = "CASE WHEN {m} < 0.75 THEN 1.0::DOUBLE + {m} * (0.25::DOUBLE + {m} * -0.125::DOUBLE) ELSE 1.125::DOUBLE + {m} * (-0.0625::DOUBLE + {m} * (0.03125::DOUBLE + {m} * 0.015625::DOUBLE)) END"
LEG_SQL = {0: "1.0::DOUBLE", 2: "(1.5::DOUBLE * {m} * {m} - 0.5::DOUBLE)", 4: "(4.375::DOUBLE * {m} * {m} * {m} * {m} - 3.75::DOUBLE * {m} * {m} + 0.375::DOUBLE)"}


def phi(r, mu):
    return geometry.survey_correction(mu, F.array(*map(F.lit, COEF)))


def _vol(r: str) -> str:
    return "CASE {} {} END".format(r, " ".join(f"WHEN {i} THEN 4 * pi() / 3 * ({hi}::DOUBLE * {hi} * {hi} - {lo}::DOUBLE * {lo} * {lo})" for i, (lo, hi) in enumerate(B.edges)))


def volumes():
    import math

    return [4 * math.pi / 3 * (hi**3 - lo**3) for lo, hi in B.edges]


def _phi(r, mu):
    """phi() of arrays."""
    a0, a1, a2, b0, b1, b2, b3 = COEF
    return np.where(mu < geometry.MU_JOIN, a0 + mu * (a1 + mu * a2), b0 + mu * (b1 + mu * (b2 + mu * b3)))


ACCUMULATED = tuples.accumulated(B, 4, _phi, volumes())


def accumulated(sums):
    return rounded(tuples.moments(sums, 4).withColumn("value", F.col("value") * 1e6), "value")


def _acc(source: str, value: str, rb: str, mb: str) -> str:
    sides = lambda r, m: " UNION ALL ".join(f"SELECT {l} AS l" for l in LEG_SQL)
    leg = lambda l, m: "CASE {} {} END".format(l, " ".join(f"WHEN {k} THEN {v.format(m=m)} * {2 * k + 1}" for k, v in LEG_SQL.items()))
    return f"""SELECT r_bin AS r_a, p.l AS p, {rb} AS r_b, q.l AS q, round(sum({value} * ({PHI_SQL.format(m='mu')}) / ({_vol('r_bin')}) * ({leg('p.l', 'mu')}) * ({PHI_SQL.format(m=mb)}) / ({_vol(rb)}) * ({leg('q.l', mb)})) * 1e6, 6) AS value
FROM {source}, ({sides('', '')}) p, ({sides('', '')}) q GROUP BY 1, 2, 3, 4"""


@query(f"WITH {fx.PTS}, {LEG} {_acc('leg', '2 * wi * wi * wj * wj * (1 + xi)', 'r_bin', 'mu')}")
def c2_legendre_accumulated(spark, sf_dir):
    return accumulated(tuples.spread(tuples.two(fx.points(spark, sf_dir), ACCUMULATED, fx.xi), ACCUMULATED.n))


@query(f"WITH {fx.PTS}, {LEG}, {TRI} {_acc('tri', '4 * wi * wj * wj * wk * x', 'r_b', 'mu_b')}")
def c3_legendre_accumulated(spark, sf_dir):
    return accumulated(c3(spark, sf_dir, ACCUMULATED))


@query(f"WITH {fx.PTS}, {LEG}, {QUAD} {_acc('quad', '2 * wi * wj * wk * wl * x * y', 'r_b', 'mu_b')}")
def c4_legendre_accumulated(spark, sf_dir):
    return accumulated(c4(spark, sf_dir, ACCUMULATED))


@query(f"WITH {fx.PTS}, {LEG}, {QUAD}, {FAC}, t AS (SELECT a, b, 2 * sum(wi * wj * wk * wl * x * y) AS v FROM quad GROUP BY a, b) {_projected('t')}")
def c4_legendre_projected(spark, sf_dir):
    return rounded(terms.projected(c4(spark, sf_dir), multipoles.mu_factors(spark, B.n_mu, 4), B.n_mu), "value")


@query(f"WITH {fx.PTS}, {LEG} SELECT i, j, round({PHI_SQL.format(m='mu')}, 9) AS phi FROM leg")
def survey_correction_eval(spark, sf_dir):
    return rounded(legs(spark, sf_dir).select("i", "j", phi(F.col("r_bin"), F.col("mu")).alias("phi")), "phi", digits=9)


@query(f"""WITH {fx.PTS}, {LEG} SELECT i, j, round(CASE WHEN x < 0.5 THEN 1 WHEN x < 0.75 THEN 1 - 8 * pow(2 * x - 1, 3) + 8 * pow(2 * x - 1, 4) WHEN x <= 1 THEN -64 * pow(x - 1, 3) - 128 * pow(x - 1, 4) END, 9) AS weight
FROM (SELECT id1 AS i, id2 AS j, s / 35.0::DOUBLE AS x FROM bp)""")
def pair_window(spark, sf_dir):
    leg = legs(spark, sf_dir)
    return rounded(leg.select("i", "j", geometry.pair_window(F.col("s"), 35.0).alias("weight")), "weight", digits=9)


# ---- power -----------------------------------------------------------------------------------------------------------
R0, SHELLS, INV_PHI = 40.0, [(0.05, 0.1), (0.1, 0.2)], (1.0, 0.015625, 0.0, 0.125, 0.0, 0.0, 0.0, 0.0, 0.00390625)
_W = "(CASE WHEN {s} / 40 < 0.5 THEN 1 WHEN {s} / 40 < 0.75 THEN 1 - 8 * pow(2 * {s} / 40 - 1, 3) + 8 * pow(2 * {s} / 40 - 1, 4) WHEN {s} / 40 <= 1 THEN -64 * pow({s} / 40 - 1, 3) - 128 * pow({s} / 40 - 1, 4) END)"
_IP = "(1 + {s} * 0.015625::DOUBLE + (1.5::DOUBLE * {m} * {m} - 0.5::DOUBLE) * 0.125::DOUBLE + (4.375::DOUBLE * pow({m}, 4) - 3.75::DOUBLE * {m} * {m} + 0.375::DOUBLE) * 0.00390625::DOUBLE * {s} * {s})"
#: Means of j_0 over shells: 3 [F(hi r) - F(lo r)] / (r^3 (hi^3 - lo^3)), F(x) = sin x - x cos x.
_K0 = "(3 * ((sin(hi{k} * {s}) - hi{k} * {s} * cos(hi{k} * {s})) - (sin(lo{k} * {s}) - lo{k} * {s} * cos(lo{k} * {s}))) / ({s} * {s} * {s} * (hi{k} * hi{k} * hi{k} - lo{k} * lo{k} * lo{k})))"
_PLEG = LEG.replace("leg AS (SELECT id1 AS i", "leg AS (SELECT s, id1 AS i")
_PTRI = TRI.replace("tri AS (SELECT p.a", "tri AS (SELECT p.s, q.s AS s_b, p.a")
_PQUAD = QUAD.replace("quad AS (SELECT p.a", "quad AS (SELECT p.s, q.s AS s_b, p.a")


def _power(source: str, value: str, s_b: str, mu_b: str) -> str:
    f = lambda k, s, m: f"{_W.format(s=s)} / {_IP.format(s=s, m=m)} * {_K0.format(k=k, s=s)}"
    shells = lambda n: f"(VALUES (0, 0.05::DOUBLE, 0.1::DOUBLE), (1, 0.1::DOUBLE, 0.2::DOUBLE)) t{n}(k{n}, lo{n}, hi{n})"
    return f"SELECT k1::INTEGER AS k_a, 0 AS p, k2::INTEGER AS k_b, 0 AS q, round(sum({value} * {f(1, 's', 'mu')} * {f(2, s_b, mu_b)}), 6) AS value FROM {source}, {shells(1)}, {shells(2)} WHERE s <= 40 AND {s_b} <= 40 GROUP BY 1, 3"


def power_leg(max_l: int = 0, coef=INV_PHI):
    return power.leg_of(B, R0, SHELLS, max_l, coef)


@query(f"WITH {fx.PTS}, {_PLEG} {_power('leg', '2 * wi * wi * wj * wj * (1 + xi)', 's', 'mu')}")
def power_c2_monopole(spark, sf_dir):
    return rounded(power.placed(tuples.spread(tuples.two(fx.points(spark, sf_dir), power_leg(), fx.xi), len(SHELLS)), 0), "value")


@query(f"WITH {fx.PTS}, {_PLEG}, {_PTRI} {_power('tri', '4 * wi * wj * wj * wk * x', 's_b', 'mu_b')}")
def power_c3_monopole(spark, sf_dir):
    return rounded(power.placed(c3(spark, sf_dir, power_leg()), 0), "value")


@query(f"WITH {fx.PTS}, {_PLEG}, {_PQUAD} {_power('quad', '2 * wi * wj * wk * wl * x * y', 's_b', 'mu_b')}")
def power_c4_monopole(spark, sf_dir):
    return rounded(power.placed(c4(spark, sf_dir, power_leg()), 0), "value")


# ---- triangles -------------------------------------------------------------------------------------------------------
TRIANGLE_BINS = pairs.Bins(((10.0, 25.0), (25.0, 40.0)), n_mu=4, mu_low=-1.0, mu_high=1.0)


def _rbin(s: str) -> str:
    return "CASE " + " ".join(f"WHEN {s} >= {lo} AND {s} < {hi} THEN {i}" for i, (lo, hi) in enumerate(TRIANGLE_BINS.edges)) + " END"


_SIDES = f"""{fx.pairs_sql('sd', 'pts', 'pts', B.r_min, B.r_max)},
tr AS (SELECT p.id1 AS i, p.id2 AS j, q.id2 AS k, p.w1 AS wi, p.w2 AS wj, q.w2 AS wk, p.s AS ij, q.s AS ik, o.s AS jk FROM sd p JOIN sd q ON p.id1 = q.id1 AND p.id2 < q.id2 JOIN sd o ON o.id1 = p.id2 AND o.id2 = q.id2 WHERE p.id1 < p.id2),
an AS (SELECT *, (ij * ij + ik * ik - jk * jk) / (2 * ij * ik) AS ci, (ij * ij + jk * jk - ik * ik) / (2 * ij * jk) AS cj, (ik * ik + jk * jk - ij * ij) / (2 * ik * jk) AS ck FROM tr),
ch AS (SELECT i, j, k, wi, wj, wk, unnest([{{'s1': ij, 's2': ik, 'c': ci}}, {{'s1': ij, 's2': jk, 'c': cj}}, {{'s1': ik, 's2': jk, 'c': ck}}]) AS t FROM an),
bt AS (SELECT *, {_rbin('t.s1')} AS x1, {_rbin('t.s2')} AS x2, least(floor((t.c + 1) / 0.5::DOUBLE)::INTEGER, 3) AS mu_bin FROM ch)"""


@query(f"WITH {fx.PTS}, {_SIDES} SELECT least(x1, x2) AS r1, greatest(x1, x2) AS r2, mu_bin, count(*) AS n, round(sum(2 * wi * wj * wk), 6) AS rrr FROM bt GROUP BY 1, 2, 3")
def triple_counts(spark, sf_dir):
    return rounded(triples.counts(fx.points(spark, sf_dir), TRIANGLE_BINS), "rrr")


@query(f"""WITH {fx.PTS}, {_SIDES}, f AS (SELECT i, j, k, least(x1, x2) * 100 + greatest(x1, x2) * 10 + mu_bin AS b, x1, x2, wi, wj, wk,
  CASE WHEN t.s1 = (SELECT 0) THEN 0 ELSE t.s1 END AS s1 FROM bt), m AS (SELECT an.i, an.j, an.k, 9 * ({fx.XI_AMPLITUDE} / (ij * ij) + {fx.XI_AMPLITUDE} / (ik * ik) + {fx.XI_AMPLITUDE} / (jk * jk)) + 9 AS g FROM an),
v AS (SELECT f.i, f.j, f.k, least(x1, x2) AS r1, greatest(x1, x2) AS r2, (b % 10)::INTEGER AS mu_bin, wi * wi * wj * wj * wk * wk * g AS v FROM f JOIN m ON f.i = m.i AND f.j = m.j AND f.k = m.k)
SELECT a.r1 AS r1, a.r2 AS r2, a.mu_bin AS mu_a, b.r1 AS r3, b.r2 AS r4, b.mu_bin AS mu_b, round(sum(a.v), 6) AS value FROM v a JOIN v b ON a.i = b.i AND a.j = b.j AND a.k = b.k GROUP BY 1, 2, 3, 4, 5, 6""")
def c3_3pcf_exact(spark, sf_dir):
    return rounded(triples.three_point_term(fx.points(spark, sf_dir), TRIANGLE_BINS, fx.xi), "value")
