"""Queries of pair counts, correlation functions and their multipoles, and by jackknife region."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from galacov.operators import blocks, covariance, jackknife, multipoles, pairs
from galacov.plans import fixtures as fx
from galacov.plans.catalog_queries import rounded
from galacov.plans.registry import query

B = fx.BINS
#: Counts in mu from -1 to 1 are made of these by a sign per pair; natural and periodic counts use a box.
RR = f"{fx.pairs_sql('pr', 'pts', 'pts', B.r_min, B.r_max)}, {fx.binned_sql('bp', 'pr')}"
PB = f"{fx.pairs_sql('pr', 'pts', 'pts', B.r_min, B.r_max, box=fx.BOX)}, {fx.binned_sql('bp', 'pr')}"


def _counts_sql(name: str, left: str, right: str, auto: bool, box=None) -> str:
    cond = "a.id <> b.id" if auto else "true"
    return f"""{fx.pairs_sql('p_' + name, left, right, B.r_min, B.r_max, cond, box)}, {fx.binned_sql('b_' + name, 'p_' + name)},
{name} AS (SELECT g.r_bin, g.mu_bin, count(p.bin) AS npairs, coalesce(sum(p.w1 * p.w2), 0)::DOUBLE AS wpairs FROM grid g LEFT JOIN b_{name} p ON g.r_bin = p.r_bin AND g.mu_bin = p.mu_bin GROUP BY g.r_bin, g.mu_bin)"""


HEAD = f"WITH {fx.PTS}, {fx.grid_sql()}, dat AS (SELECT * FROM pts WHERE is_data), ran AS (SELECT * FROM pts WHERE NOT is_data), t1 AS (SELECT * FROM pts WHERE tracer = 1), t2 AS (SELECT * FROM pts WHERE tracer = 2)"


def split(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    d, r = p.where("is_data"), p.where("not is_data")
    sums = p.groupBy("is_data").agg(F.sum("w").alias("s")).collect()  # two rows
    s = {row["is_data"]: row["s"] for row in sums}
    return d, r, s.get(True, 0.0), s.get(False, 0.0)


@query(f"{HEAD}, {_counts_sql('rr', 'pts', 'pts', True)} SELECT * FROM rr")
def pair_counts(spark, sf_dir):
    return pairs.count(fx.points(spark, sf_dir), None, B)


@query(f"{HEAD}, {_counts_sql('rr', 'pts', 'pts', True, fx.BOX)} SELECT r_bin, mu_bin, npairs, wpairs FROM rr")
def pair_counts_periodic(spark, sf_dir):
    return pairs.count(fx.points(spark, sf_dir), None, B, box=fx.BOX)


@query(f"{HEAD}, {_counts_sql('rr', 't1', 't2', False)} SELECT * FROM rr")
def pair_counts_cross(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    return pairs.count(p.where("tracer = 1"), p.where("tracer = 2"), B)


_RR_ANA = f"{fx.grid_sql()}, edges AS (SELECT * FROM (VALUES {', '.join(f'({i}, {lo}::DOUBLE, {hi}::DOUBLE)' for i, (lo, hi) in enumerate(B.edges))}) e(r_bin, lo, hi))"


@query(f"WITH {_RR_ANA} SELECT g.r_bin, g.mu_bin, round(4 * pi() / 3 * (hi * hi * hi - lo * lo * lo) * (100.0 * 100.0 / {fx.BOX ** 3} / {B.n_mu}), 6) AS rr FROM grid g JOIN edges e ON g.r_bin = e.r_bin")
def rr_analytic(spark, sf_dir):
    return rounded(pairs.analytic_rr(spark, B, 100.0, fx.BOX), "rr")


_LS = f"""{HEAD}, {_counts_sql('dd', 'dat', 'dat', True)}, {_counts_sql('dr', 'dat', 'ran', False)}, {_counts_sql('rr', 'ran', 'ran', True)},
s AS (SELECT sum(w) FILTER (is_data) AS d, sum(w) FILTER (NOT is_data) AS r FROM pts),
n AS (SELECT dd.r_bin, dd.mu_bin, dd.wpairs / (s.d * s.d) AS dd, dr.wpairs / (s.d * s.r) AS dr, rr.wpairs / (s.r * s.r) AS rr
      FROM dd JOIN dr USING (r_bin, mu_bin) JOIN rr USING (r_bin, mu_bin), s),
xi AS (SELECT r_bin, mu_bin, dd, dr, rr, CASE WHEN rr <> 0 THEN (dd - dr - dr + rr) / rr END AS xi FROM n)"""


def landy_szalay(spark, sf_dir):
    d, r, sd, sr = split(spark, sf_dir)
    return pairs.landy_szalay(pairs.count(d, None, B), pairs.count(d, r, B), pairs.count(r, None, B), sd, sr)


@query(f"{_LS} SELECT r_bin, mu_bin, round(dd, 9) AS dd, round(dr, 9) AS dr, round(rr, 9) AS rr, round(xi, 6) AS xi FROM xi")
def xi_landy_szalay(spark, sf_dir):
    found = landy_szalay(spark, sf_dir).drop("rd")
    return rounded(rounded(found, "dd", "dr", "rr", digits=9), "xi")


@query(f"{HEAD}, {_counts_sql('dd', 'pts', 'pts', True, fx.BOX)}, edges AS (SELECT * FROM (VALUES {', '.join(f'({i}, {lo}::DOUBLE, {hi}::DOUBLE)' for i, (lo, hi) in enumerate(B.edges))}) e(r_bin, lo, hi)), s AS (SELECT sum(w) AS s FROM pts) SELECT dd.r_bin, dd.mu_bin, round(dd.wpairs / (s * s) / (4 * pi() / 3 * (hi * hi * hi - lo * lo * lo) / {fx.BOX ** 3} / {B.n_mu}) - 1, 6) AS xi FROM dd JOIN edges e ON dd.r_bin = e.r_bin, s")
def xi_natural(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    total = p.agg(F.sum("w")).first()[0] or 1.0
    found = pairs.natural(pairs.count(p, None, B, box=fx.BOX), pairs.analytic_rr(spark, B, 1.0, fx.BOX), total, 1.0)
    return rounded(found.select("r_bin", "mu_bin", "xi"), "xi")


_X = f"""{HEAD}, d1 AS (SELECT * FROM t1 WHERE is_data), d2 AS (SELECT * FROM pts WHERE tracer = 1 AND NOT is_data), r1 AS (SELECT * FROM t2 WHERE jack < 5), r2 AS (SELECT * FROM t2 WHERE jack >= 5)"""


@query(f"""{_X}, {_counts_sql('dd', 'd1', 'd2', False)}, {_counts_sql('dr', 'd1', 'r2', False)}, {_counts_sql('rd', 'r1', 'd2', False)}, {_counts_sql('rr', 'r1', 'r2', False)},
s AS (SELECT (SELECT sum(w) FROM d1) AS a, (SELECT sum(w) FROM d2) AS b, (SELECT sum(w) FROM r1) AS c, (SELECT sum(w) FROM r2) AS d),
n AS (SELECT dd.r_bin, dd.mu_bin, dd.wpairs / (a * b) AS dd, dr.wpairs / (a * d) AS dr, rd.wpairs / (c * b) AS rd, rr.wpairs / (c * d) AS rr
      FROM dd JOIN dr USING (r_bin, mu_bin) JOIN rd USING (r_bin, mu_bin) JOIN rr USING (r_bin, mu_bin), s)
SELECT r_bin, mu_bin, round(CASE WHEN rr <> 0 THEN (dd - dr - rd + rr) / rr END, 6) AS xi FROM n""")
def xi_cross(spark, sf_dir):
    """Two tracers: data and randoms of each."""
    p = fx.points(spark, sf_dir)
    sides = [p.where("tracer = 1 and is_data"), p.where("tracer = 1 and not is_data"), p.where("tracer = 2 and jack < 5"), p.where("tracer = 2 and jack >= 5")]
    a, b, c, d = ((t.agg(F.sum("w")).first()[0] or 1.0) for t in sides)
    d1, d2, r1, r2 = sides
    found = pairs.landy_szalay(pairs.count(d1, d2, B), pairs.count(d1, r2, B), pairs.count(r1, r2, B), a, c, rd=pairs.count(r1, d2, B), data2_sum=b, random2_sum=d)
    return rounded(found.select("r_bin", "mu_bin", "xi"), "xi")


@query(f"{_LS}, ss AS (SELECT r_bin, mu_bin, wpairs + 1 AS wpairs FROM rr) SELECT xi.r_bin, xi.mu_bin, round(xi.xi * rr.wpairs / ss.wpairs, 6) AS xi FROM xi JOIN rr USING (r_bin, mu_bin) JOIN ss USING (r_bin, mu_bin)")
def xi_postrecon(spark, sf_dir):
    d, r, sd, sr = split(spark, sf_dir)
    rr = pairs.count(r, None, B)
    xi = pairs.landy_szalay(pairs.count(d, None, B), pairs.count(d, r, B), rr, sd, sr)
    return rounded(pairs.post_reconstruction(xi, rr, rr.withColumn("wpairs", F.col("wpairs") + 1)), "xi")


@query(f"{HEAD}, {_counts_sql('rr', 'pts', 'pts', True)} SELECT (r_bin // 2)::INTEGER AS r_bin, (mu_bin // 3)::INTEGER AS mu_bin, sum(npairs)::BIGINT AS npairs, sum(wpairs) AS wpairs FROM rr GROUP BY 1, 2")
def rebin_counts(spark, sf_dir):
    return pairs.rebinned(pairs.count(fx.points(spark, sf_dir), None, B), 2, 3, ["npairs", "wpairs"])


_SIGNED = "CASE WHEN (id1 + id2) % 2 = 0 THEN mu_bin + 3 ELSE 2 - mu_bin END"


def signed_counts(spark, sf_dir):
    """Counts in six bins of mu from -1 to 1, the sign by parity of the ids."""
    def each(a, i, b, j, s, mu):
        flat = blocks.flat_bins(B, s, mu)
        r, m = np.divmod(flat, B.n_mu)
        m = np.where((a.id[i] + b.id[j]) % 2 == 0, m + B.n_mu, B.n_mu - 1 - m)
        return [([(np.where(flat >= 0, r, -1), len(B.edges)), (m, 2 * B.n_mu)], [a.w[i] * b.w[j]])]

    met = blocks.pair_sums(fx.points(spark, sf_dir), None, B.r_max, B.r_min, each, ["r_bin", "mu_bin"], ["wpairs"])
    return met.select("r_bin", "mu_bin", (F.col("wpairs") * 2).alias("wpairs"))


@query(f"WITH {fx.PTS}, {RR}, c AS (SELECT r_bin, {_SIGNED} AS m, sum(w1 * w2) AS wpairs FROM bp GROUP BY 1, 2) SELECT r_bin, CASE WHEN m >= 3 THEN m - 3 ELSE 2 - m END::INTEGER AS mu_bin, sum(wpairs) AS wpairs FROM c GROUP BY 1, 2")
def wrap_mu(spark, sf_dir):
    return pairs.wrapped(signed_counts(spark, sf_dir), 6, ["wpairs"])


@query(f"WITH {fx.PTS}, {RR}, c AS (SELECT r_bin, {_SIGNED}::INTEGER AS mu_bin, sum(w1 * w2) - 40 AS v FROM bp GROUP BY 1, 2) SELECT a.r_bin, a.mu_bin, CASE WHEN a.v < 0 AND b.v >= 0 THEN b.v ELSE a.v END AS wpairs FROM c a LEFT JOIN c b ON a.r_bin = b.r_bin AND b.mu_bin = 5 - a.mu_bin")
def fix_negative_bins(spark, sf_dir):
    c = signed_counts(spark, sf_dir).withColumn("wpairs", F.col("wpairs") - 40)
    return pairs.mirror_fixed(c, 6, "wpairs").select("r_bin", "mu_bin", "wpairs")


@query(f"{HEAD}, {_counts_sql('rr', 'pts', 'pts', True)}, v AS (SELECT r_bin, mu_bin, (r_bin + 1) * 15.0::DOUBLE AS s, wpairs FROM rr) SELECT r_bin, mu_bin, s, CASE WHEN s < 20 THEN wpairs / 8 / 8 ELSE wpairs / 8 END AS rr FROM v")
def scaled_counts(spark, sf_dir):
    c = pairs.count(fx.points(spark, sf_dir), None, B).select("r_bin", "mu_bin", ((F.col("r_bin") + 1) * 15.0).alias("s"), F.col("wpairs").alias("rr"))
    return pairs.scaled_counts(c, 8.0, 20.0)


@query(f"{HEAD}, {_counts_sql('rr', 'pts', 'pts', True)} SELECT (r_bin - 1)::INTEGER AS r_bin, mu_bin, wpairs FROM rr WHERE r_bin >= 1")
def skip_radial_bins(spark, sf_dir):
    return pairs.cut(pairs.count(fx.points(spark, sf_dir), None, B), 1, 0, len(B.edges)).select("r_bin", "mu_bin", "wpairs")


# ---- jackknife -------------------------------------------------------------------------------------------------------
JK = f"{RR}, jc AS (SELECT jack, r_bin, mu_bin, bin, sum(v) AS value FROM (SELECT r_bin, mu_bin, bin, unnest([jack1, jack2]) AS jack, w1 * w2 * 0.5::DOUBLE AS v FROM bp) GROUP BY jack, r_bin, mu_bin, bin)"
JW = f"{JK}, jt AS (SELECT bin, sum(value) AS total FROM jc GROUP BY bin), jw AS (SELECT jack, jc.bin, r_bin, mu_bin, value / total AS weight FROM jc JOIN jt ON jc.bin = jt.bin)"
JP = f"{JW}, jp AS (SELECT a.bin AS bin_a, b.bin AS bin_b, sum(a.weight * b.weight) AS value FROM jw a JOIN jw b ON a.jack = b.jack GROUP BY 1, 2)"


def weights(spark, sf_dir):
    return jackknife.flat(jackknife.weights(jackknife.pair_counts(fx.points(spark, sf_dir), B)), B.n_mu)


@query(f"WITH {fx.PTS}, {JK} SELECT jack, r_bin, mu_bin, value FROM jc")
def jack_pair_counts(spark, sf_dir):
    return jackknife.pair_counts(fx.points(spark, sf_dir), B).select("jack", "r_bin", "mu_bin", "value")


@query(f"WITH {fx.PTS}, {JW} SELECT jack, r_bin, mu_bin, round(weight, 9) AS weight FROM jw")
def jack_weights(spark, sf_dir):
    return rounded(weights(spark, sf_dir).select("jack", "r_bin", "mu_bin", "weight"), "weight", digits=9)


@query(f"WITH {fx.PTS}, {JP} SELECT bin_a, bin_b, round(value, 9) AS value FROM jp")
def jack_product_weights(spark, sf_dir):
    return rounded(jackknife.product_weights(weights(spark, sf_dir)), "value", digits=9)


def _jack_counts(name: str, source: str) -> str:
    return f"{name} AS (SELECT jack, r_bin, mu_bin, sum(v) AS value FROM (SELECT r_bin, mu_bin, unnest([jack1, jack2]) AS jack, w1 * w2 * 0.5::DOUBLE AS v FROM {source}) GROUP BY jack, r_bin, mu_bin)"


_JXI = f"""{HEAD}, {_counts_sql('dd', 'dat', 'dat', True)}, {_counts_sql('dr', 'dat', 'ran', False)}, {_counts_sql('rd', 'ran', 'dat', False)}, {_counts_sql('rr', 'ran', 'ran', True)},
{_jack_counts('jdd', 'b_dd')}, {_jack_counts('jdr', 'b_dr')}, {_jack_counts('jrd', 'b_rd')}, {_jack_counts('jrr', 'b_rr')},
s AS (SELECT sum(w) FILTER (is_data) AS d, sum(w) FILTER (NOT is_data) AS r FROM pts),
jn AS (SELECT jack, r_bin, mu_bin, coalesce(jdd.value, 0) / (d * d) AS dd, (coalesce(jdr.value, 0) + coalesce(jrd.value, 0)) / 2 / (d * r) AS x, jrr.value / (r * r) AS rr
  FROM jrr LEFT JOIN jdd USING (jack, r_bin, mu_bin) LEFT JOIN jdr USING (jack, r_bin, mu_bin) LEFT JOIN jrd USING (jack, r_bin, mu_bin), s),
jxi AS (SELECT jack, r_bin, mu_bin, r_bin * {B.n_mu} + mu_bin AS bin, (dd - 2 * x + rr) / rr AS xi, rr FROM jn)"""


def region_xi(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    d, r = p.where("is_data"), p.where("not is_data")
    sums = p.groupBy("jack").agg(F.sum(F.when(F.col("is_data"), F.col("w"))).alias("data"), F.sum(F.when(~F.col("is_data"), F.col("w"))).alias("random"))
    rr = jackknife.pair_counts(r, B)
    return jackknife.landy_szalay(jackknife.pair_counts(d, B), jackknife.cross_counts(d, r, B), jackknife.cross_counts(r, d, B), rr, sums), rr


@query(f"{_JXI} SELECT jack, r_bin, mu_bin, round(xi, 6) AS xi FROM jxi")
def jack_xi(spark, sf_dir):
    return rounded(region_xi(spark, sf_dir)[0], "xi")


@query(f"""{_JXI}, jt AS (SELECT bin, sum(rr) AS t FROM jxi GROUP BY bin), w AS (SELECT jack, jxi.bin, rr / t AS w, xi FROM jxi JOIN jt ON jxi.bin = jt.bin),
m AS (SELECT bin, sum(w * xi) / sum(w) AS m FROM w GROUP BY bin), d AS (SELECT jack, w.bin, w, xi - m AS d FROM w JOIN m ON w.bin = m.bin)
SELECT a.bin AS bin_a, b.bin AS bin_b, round(sum(a.w * b.w * a.d * b.d) / (1 - sum(a.w * b.w)), 6) AS value FROM d a JOIN d b ON a.jack = b.jack GROUP BY 1, 2""")
def jack_data_cov(spark, sf_dir):
    xi, rr = region_xi(spark, sf_dir)
    return rounded(jackknife.data_covariance(jackknife.flat(xi, B.n_mu).select("jack", "bin", "xi"), jackknife.flat(jackknife.weights(rr), B.n_mu).select("jack", "bin", "weight")), "value")


@query(f"""WITH {fx.PTS}, {JP}, h AS (SELECT half1 AS half, bin, unnest([jack1, jack2]) AS jack, w1 * w2 * 0.5::DOUBLE / 0.25::DOUBLE AS w, s FROM bp WHERE half1 = half2),
g AS (SELECT half, jack, bin, sum(w) AS rr, sum(w * ({fx.XI_AMPLITUDE} / (s * s))) AS ee FROM h GROUP BY 1, 2, 3), t AS (SELECT half, bin, sum(rr) AS trr, sum(ee) AS tee FROM g GROUP BY 1, 2),
d AS (SELECT g.half, jack, g.bin, ee - rr / trr * tee AS d FROM g JOIN t ON g.half = t.half AND g.bin = t.bin), rb AS (SELECT bin, sum(w1 * w2) AS rr FROM bp GROUP BY bin),
c AS (SELECT a.bin AS bin_a, b.bin AS bin_b, sum(a.d * b.d) AS c FROM d a JOIN d b ON a.jack = b.jack WHERE a.half = 0 AND b.half = 1 GROUP BY 1, 2)
SELECT c.bin_a, c.bin_b, round(c.c / (x.rr * y.rr * (1 - p.value)), 9) AS value FROM c JOIN jp p ON c.bin_a = p.bin_a AND c.bin_b = p.bin_b JOIN rb x ON c.bin_a = x.bin JOIN rb y ON c.bin_b = y.bin""")
def jack_disconnected(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    rr = jackknife.flat(pairs.count(p, None, B), B.n_mu).select("bin", F.col("wpairs").alias("rr"))
    found = jackknife.disconnected(jackknife.half_counts(p, B, fx.xi, arrays=True), rr, jackknife.product_weights(weights(spark, sf_dir)))
    return rounded(found, "value", digits=9)


# ---- multipoles ------------------------------------------------------------------------------------------------------
def factors_sql(n: int, inverse: bool = False) -> str:
    """mu_bin, l, factor for l = 0, 2, 4."""
    anti = {0: "{0}", 2: "(0.5::DOUBLE * {0} * {0} * {0} - 0.5::DOUBLE * {0})", 4: "(0.875::DOUBLE * {0} * {0} * {0} * {0} * {0} - 1.25::DOUBLE * {0} * {0} * {0} + 0.375::DOUBLE * {0})"}
    scale = lambda l: "/ (hi - lo)" if inverse else f"* {2 * l + 1}"
    return " UNION ALL ".join(f"SELECT mu_bin, {l} AS l, ({anti[l].format('hi')} - {anti[l].format('lo')}) {scale(l)} AS factor FROM (SELECT i::INTEGER AS mu_bin, i / {n}::DOUBLE AS lo, (i + 1) / {n}::DOUBLE AS hi FROM range({n}) t(i))" for l in anti)


@query(f"SELECT a.mu_bin, a.l, round(a.factor, 9) AS factor, round(b.factor, 9) AS inverse FROM ({factors_sql(12)}) a JOIN ({factors_sql(12, True)}) b ON a.mu_bin = b.mu_bin AND a.l = b.l")
def legendre_factors(spark, sf_dir):
    inv = multipoles.mu_factors(spark, 12, 4, inverse=True).withColumnRenamed("factor", "inverse")
    return rounded(multipoles.mu_factors(spark, 12, 4).join(inv, ["mu_bin", "l"]), "factor", "inverse", digits=9)


@query(f"{_LS}, f AS ({factors_sql(B.n_mu)}) SELECT r_bin, l, round(sum(xi * factor), 6) AS xi_l FROM xi JOIN f ON xi.mu_bin = f.mu_bin GROUP BY 1, 2")
def xi_multipoles(spark, sf_dir):
    return rounded(multipoles.to_multipoles(landy_szalay(spark, sf_dir).select("r_bin", "mu_bin", "xi"), multipoles.mu_factors(spark, B.n_mu, 4)), "xi_l")


MOCKS = "mk AS (SELECT user_id AS mock, (dense_rank() OVER (ORDER BY event_type) - 1)::INTEGER AS bin, xi FROM (SELECT user_id, event_type, avg(value) AS xi FROM events GROUP BY 1, 2))"


def mocks(spark, sf_dir):
    """mock, bin, xi: users are realisations and event types bins, numbered by name."""
    e = fx.read(spark, sf_dir, "events")
    names = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # as many as bins
    number = F.array_position(F.array(*map(F.lit, names)), F.col("event_type")) - 1
    return e.groupBy(F.col("user_id").alias("mock"), number.cast("int").alias("bin")).agg(F.avg("value").alias("xi"))


@query(f'WITH {MOCKS} SELECT a.bin AS "row", b.bin AS col, round(covar_samp(a.xi, b.xi), 6) AS value FROM mk a JOIN mk b ON a.mock = b.mock GROUP BY 1, 2')
def sample_cov(spark, sf_dir):
    return rounded(covariance.sample_covariance(mocks(spark, sf_dir)), "value")


@query(f"""WITH {MOCKS}, f AS ({factors_sql(5)}), x AS (SELECT mock, l, sum(xi * factor) AS v FROM mk JOIN f ON mk.bin = f.mu_bin GROUP BY 1, 2)
SELECT (a.l // 2)::INTEGER AS "row", (b.l // 2)::INTEGER AS col, round(covar_samp(a.v, b.v), 6) AS value FROM x a JOIN x b ON a.mock = b.mock GROUP BY 1, 2""")
def sample_cov_multipoles(spark, sf_dir):
    m = mocks(spark, sf_dir).select("mock", F.lit(0).alias("r_bin"), F.col("bin").alias("mu_bin"), "xi")
    x = multipoles.to_multipoles(m, multipoles.mu_factors(spark, 5, 4), ("mock",))
    return rounded(covariance.sample_covariance(x.select("mock", (F.col("l") / 2).cast("int").alias("bin"), F.col("xi_l").alias("xi"))), "value")


_SERIES = "se AS (SELECT (event_id % 24)::INTEGER AS r_bin, 0 AS l, avg(value) AS xi_l FROM events GROUP BY 1)"


@query(f"""WITH {_SERIES}, q AS (SELECT r_bin, l, (r_bin + 1) * (r_bin + 1) * 25.0::DOUBLE * xi_l AS v FROM se), w AS (
  SELECT r_bin, l, (-3 * lag(v, 2) OVER o + 12 * lag(v, 1) OVER o + 17 * v + 12 * lead(v, 1) OVER o - 3 * lead(v, 2) OVER o) / 35 / ((r_bin + 1) * (r_bin + 1) * 25.0::DOUBLE) AS x FROM q WINDOW o AS (ORDER BY r_bin))
SELECT r_bin, l, round(x, 6) AS xi_l FROM w WHERE x IS NOT NULL""")
def smoothed_multipoles(spark, sf_dir):
    """The inside of the series: its ends are fits, tested apart."""
    s = fx.read(spark, sf_dir, "events").groupBy((F.col("event_id") % 24).cast("int").alias("r_bin")).agg(F.avg("value").alias("xi_l")).withColumn("l", F.lit(0))
    found = multipoles.smoothed(s, {i: 5.0 * (i + 1) for i in range(24)}, 5, 2)
    return rounded(found.where("r_bin >= 2 and r_bin < 22").select("r_bin", "l", "xi_l"), "xi_l")


@query("WITH e AS (SELECT DISTINCT user_id::DOUBLE AS edge FROM events) SELECT k, mid FROM (SELECT row_number() OVER o - 1 AS k, (edge + lead(edge) OVER o) / 2 AS mid FROM e WINDOW o AS (ORDER BY edge)) WHERE mid IS NOT NULL")
def edge_midpoints(spark, sf_dir):
    return multipoles.midpoints(fx.read(spark, sf_dir, "events").select(F.col("user_id").cast("double").alias("edge")).distinct()).withColumn("k", F.col("k").cast("long"))


@query("WITH e AS (SELECT user_id::DOUBLE AS x, avg(value) AS y FROM events GROUP BY 1) SELECT round(sum(v), 6) AS integral FROM (SELECT (lead(x) OVER o - x) * (lead(y) OVER o + y) / 2 AS v FROM e WINDOW o AS (ORDER BY x))")
def trapezoid_integral(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("double").alias("x")).agg(F.avg("value").alias("y"))
    return rounded(multipoles.trapezoid(e, "x", "y"), "integral")
