"""Queries over covariance matrices and raw terms, which are made from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from galacov.operators import covariance as cov
from galacov.operators import multipoles
from galacov.plans import fixtures as fx
from galacov.plans import pair_queries as pq
from galacov.plans.catalog_queries import rounded
from galacov.plans.registry import query

#: Radial bins and inner bins of the matrices.
N_R, N_L = 4, 3
N = N_R * N_L
RAW = f"""raw AS (SELECT ['c2', 'c3', 'c4'][(event_id // 7) % 3 + 1] AS term, (user_id % 8)::INTEGER AS subsample, (event_id % {N})::INTEGER AS "row", ((event_id // {N}) % {N})::INTEGER AS col, avg(value) AS value
  FROM events GROUP BY ALL)"""
ALL = f'{RAW}, mean AS (SELECT term, "row", col, avg(value) AS value FROM raw GROUP BY term, "row", col)'
MAT = f"{ALL}, mat AS (SELECT \"row\", col, value FROM mean WHERE term = 'c4')"


def raw(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events")
    term = F.element_at(F.array(F.lit("c2"), F.lit("c3"), F.lit("c4")), F.expr("cast((event_id div 7) % 3 + 1 as int)"))
    return e.groupBy(term.alias("term"), (F.col("user_id") % 8).cast("int").alias("subsample"), (F.col("event_id") % N).cast("int").alias("row"), F.expr(f"cast((event_id div {N}) % {N} as int)").alias("col")).agg(F.avg("value").alias("value"))


def matrix(spark, sf_dir):
    return cov.full(raw(spark, sf_dir)).where("term = 'c4'").select("row", "col", "value")


@query(f'WITH {ALL} SELECT term, "row", col, round(value, 9) AS value FROM mean')
def full_terms(spark, sf_dir):
    return rounded(cov.full(raw(spark, sf_dir)), "value", digits=9)


@query(f'WITH {ALL} SELECT a.term, a."row", a.col, round((a.value + b.value) / 2, 9) AS value FROM mean a JOIN mean b ON a.term = b.term AND a."row" = b.col AND a.col = b."row"')
def symmetrize_terms(spark, sf_dir):
    m = cov.full(raw(spark, sf_dir))
    both = m.join(m.select("term", F.col("row").alias("col"), F.col("col").alias("row")), ["term", "row", "col"], "left_semi")
    return rounded(cov.symmetrised(both, ["term"]), "value", digits=9)


@query(f'''WITH {ALL} SELECT "row", col, round(sum(CASE term WHEN 'c4' THEN value WHEN 'c3' THEN 1.25 * value ELSE 1.5625 * value END) / 7, 9) AS value FROM mean GROUP BY "row", col''')
def combine_terms_alpha(spark, sf_dir):
    found = cov.combined_alpha(cov.full(raw(spark, sf_dir)), 1.25)
    return rounded(found.withColumn("value", F.col("value") / 7), "value", digits=9)  # over 7, so that no value ends in a half


_T = ", ".join(f"(1 + (event_id // {2 ** k}) % 2)::INTEGER AS t{k + 1}" for k in range(4))
_TERM = lambda n, keys, rows: f"c{n} AS (SELECT {keys}, \"row\", col, avg(value) AS value FROM (SELECT {_T}, (event_id % 3)::INTEGER AS \"row\", ((event_id // 48) % 3)::INTEGER AS col, value FROM events WHERE event_id % 5 {rows}) GROUP BY {keys}, \"row\", col)"
MULTI = ", ".join([_TERM(2, "t1, t2", "= 0"), _TERM(3, "t1, t2, t3", "= 1"), _TERM(4, "t1, t2, t3, t4", ">= 2")])


def multi(spark, sf_dir):
    """The three terms with tracers, from disjoint parts of the table."""
    e = fx.read(spark, sf_dir, "events").select(*[(1 + F.expr(f"(event_id div {2 ** k}) % 2")).cast("int").alias(f"t{k + 1}") for k in range(4)], (F.col("event_id") % 3).cast("int").alias("row"),
                                                F.expr("cast((event_id div 48) % 3 as int)").alias("col"), "value", (F.col("event_id") % 5).alias("part"))
    of = lambda n, where: e.where(where).groupBy(*[f"t{k}" for k in range(1, n + 1)], "row", "col").agg(F.avg("value").alias("value"))
    return of(2, "part = 0"), of(3, "part = 1"), of(4, "part >= 2")


def _pick(n: int, r: str, p: str, q: str) -> str:
    return f'LEFT JOIN c3 v{n} ON v{n}.t1 = c.{r} AND v{n}.t2 = c.{p} AND v{n}.t3 = c.{q} AND v{n}."row" = c."row" AND v{n}.col = c.col'


@query(f"""WITH {MULTI} SELECT c.t1, c.t2, c.t3, c.t4, c."row", c.col, round(c.value
  + CASE c.t1 WHEN 1 THEN 1.25::DOUBLE ELSE 0.75 END / 4 * ((c.t1 = c.t4)::INT * coalesce(v0.value, 0) + (c.t1 = c.t3)::INT * coalesce(v1.value, 0))
  + CASE c.t2 WHEN 1 THEN 1.25::DOUBLE ELSE 0.75 END / 4 * ((c.t2 = c.t4)::INT * coalesce(v2.value, 0) + (c.t2 = c.t3)::INT * coalesce(v3.value, 0))
  + CASE c.t1 WHEN 1 THEN 1.25::DOUBLE ELSE 0.75 END * CASE c.t2 WHEN 1 THEN 1.25::DOUBLE ELSE 0.75 END / 2 * ((c.t1 = c.t4 AND c.t2 = c.t3)::INT + (c.t1 = c.t3 AND c.t2 = c.t4)::INT) * coalesce(w.value, 0), 9) AS value
FROM c4 c {_pick(0, 't1', 't2', 't3')} {_pick(1, 't1', 't2', 't4')} {_pick(2, 't2', 't1', 't3')} {_pick(3, 't2', 't1', 't4')} LEFT JOIN c2 w ON w.t1 = c.t1 AND w.t2 = c.t2 AND w."row" = c."row" AND w.col = c.col""")
def combine_terms_multi(spark, sf_dir):
    return rounded(cov.combined_multi(*multi(spark, sf_dir), alphas=(1.25, 0.75)), "value", digits=9)


_IMG = {"c2": [((1, 2, 3, 4), 0), ((2, 1, 4, 3), 0)], "c3": [((1, 2, 3, 4), 0), ((1, 3, 2, 4), 1)], "c4": [((1, 2, 3, 4), 0), ((2, 1, 3, 4), 0), ((1, 2, 4, 3), 0), ((2, 1, 4, 3), 0), ((3, 4, 1, 2), 1), ((4, 3, 1, 2), 1), ((3, 4, 2, 1), 1), ((4, 3, 2, 1), 1)]}
_IMAGES = " UNION ALL ".join(f"""SELECT term, {', '.join(f't{i} AS t{k}' for k, i in enumerate(o, 1))}, {'col AS "row", "row" AS col' if tr else '"row", col'}, value FROM tt WHERE term = '{n}'""" for n, os in _IMG.items() for o, tr in os)


@query(f"""WITH tt AS (SELECT ['c2', 'c3', 'c4'][event_id % 3 + 1] AS term, {_T}, (event_id % 5)::INTEGER AS "row", ((event_id // 48) % 5)::INTEGER AS col, avg(value) AS value FROM events GROUP BY ALL)
SELECT term, t1, t2, t3, t4, "row", col, round(avg(value), 9) AS value FROM ({_IMAGES}) GROUP BY ALL""")
def tracer_symmetries(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events")
    term = F.element_at(F.array(F.lit("c2"), F.lit("c3"), F.lit("c4")), (F.col("event_id") % 3 + 1).cast("int"))
    t = [(1 + F.expr(f"(event_id div {2 ** k}) % 2")).cast("int").alias(f"t{k + 1}") for k in range(4)]
    m = e.groupBy(term.alias("term"), *t, (F.col("event_id") % 5).cast("int").alias("row"), F.expr("cast((event_id div 48) % 5 as int)").alias("col")).agg(F.avg("value").alias("value"))
    return rounded(cov.tracer_images(m), "value", digits=9)


@query(f"""WITH {MULTI}, b AS (SELECT CASE WHEN t1 = 1 AND t2 = 1 THEN 0 WHEN t1 <> t2 THEN 1 ELSE 2 END * 3 + "row" AS r, CASE WHEN t3 = 1 AND t4 = 1 THEN 0 WHEN t3 <> t4 THEN 1 ELSE 2 END * 3 + col AS c, avg(value) AS v FROM c4 GROUP BY 1, 2)
SELECT a.r AS "row", a.c AS col, round((a.v + b.v) / 2, 9) AS value FROM b a JOIN b ON a.r = b.c AND a.c = b.r""")
def assemble_blocks(spark, sf_dir):
    return rounded(cov.blocks(multi(spark, sf_dir)[2], 3), "value", digits=9)


@query(f"""WITH {MAT} SELECT ("row" // {N_L} - 1) * 2 + "row" % {N_L} AS "row", (col // {N_L} - 1) * 2 + col % {N_L} AS col, round(value, 9) AS value FROM mat
WHERE "row" // {N_L} BETWEEN 1 AND {N_R - 1} AND col // {N_L} BETWEEN 1 AND {N_R - 1} AND "row" % {N_L} < 2 AND col % {N_L} < 2""")
def filter_bins(spark, sf_dir):
    return rounded(cov.kept_bins(matrix(spark, sf_dir), N_R, N_L, (1, 0), 2), "value", digits=9)


@query(f"""WITH {MAT} SELECT ("row" % {N_L}) * {N_R - 1} + "row" // {N_L} AS "row", (col % {N_L}) * {N_R - 1} + col // {N_L} AS col, round(value, 9) AS value FROM mat WHERE "row" // {N_L} < {N_R - 1} AND col // {N_L} < {N_R - 1}""")
def filter_bins_legendre(spark, sf_dir):
    return rounded(cov.kept_bins(matrix(spark, sf_dir), N_R, N_L, (0, 1), inner_first=True), "value", digits=9)


@query(f'WITH {MAT} SELECT ("row" % {N_L}) * {N_R} + "row" // {N_L} AS "row", (col % {N_L}) * {N_R} + col // {N_L} AS col, round(value, 9) AS value FROM mat')
def reorder_legendre(spark, sf_dir):
    return rounded(cov.legendre_reordered(matrix(spark, sf_dir), N_R, N_L), "value", digits=9)


@query(f'WITH {MAT} SELECT "row" - 4 AS "row", col - 4 AS col, round(value, 9) AS value FROM mat WHERE "row" >= 4 AND "row" < 8 AND col >= 4 AND col < 8')
def cross_block(spark, sf_dir):
    return rounded(cov.cross_block(matrix(spark, sf_dir), N // 3), "value", digits=9)


_REG = f"""{RAW}, a AS (SELECT "row", col, avg(value) AS value FROM raw WHERE subsample < 4 GROUP BY ALL), b AS (SELECT "row", col, avg(value) AS value FROM raw WHERE subsample >= 4 GROUP BY ALL),
wa AS (SELECT (event_id % {N})::INTEGER AS bin, sum(value) AS w1 FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 GROUP BY 1), wb AS (SELECT (event_id % {N})::INTEGER AS bin, sum(value) AS w2 FROM events GROUP BY 1),
sh AS (SELECT wb.bin, coalesce(w1, 1) / (coalesce(w1, 1) + w2) AS s1, w2 / (coalesce(w1, 1) + w2) AS s2 FROM wb LEFT JOIN wa ON wa.bin = wb.bin)"""


def regions(spark, sf_dir):
    r = raw(spark, sf_dir)
    mean = lambda where: r.where(where).groupBy("row", "col").agg(F.avg("value").alias("value"))
    e = fx.read(spark, sf_dir, "events").withColumn("bin", (F.col("event_id") % N).cast("int"))
    w2 = e.groupBy("bin").agg(F.sum("value").alias("weight"))
    w1 = e.where("event_id % 2 = 0 or event_id % 3 = 0").groupBy("bin").agg(F.sum("value").alias("w"))
    w1 = w2.select("bin").join(w1, "bin", "left").select("bin", F.coalesce("w", F.lit(1.0)).alias("weight"))
    return mean("subsample < 4"), mean("subsample >= 4"), w1, w2


@query(f"""WITH {_REG}, u AS (SELECT a."row", a.col, a.value * x.s1 * y.s1 AS v FROM a JOIN sh x ON a."row" = x.bin JOIN sh y ON a.col = y.bin UNION ALL SELECT b."row", b.col, b.value * x.s2 * y.s2 FROM b JOIN sh x ON b."row" = x.bin JOIN sh y ON b.col = y.bin)
SELECT "row", col, round(sum(v), 9) AS value FROM u GROUP BY "row", col""")
def combine_regions_smu(spark, sf_dir):
    return rounded(cov.regions_combined(*regions(spark, sf_dir)), "value", digits=9)


def _legendre_shares(spark, w1, w2):
    """Shares of the first region in bins of (r, mu)."""
    both = w1.select("bin", F.col("weight").alias("a")).join(w2.select("bin", F.col("weight").alias("b")), "bin")
    rows = both.select(F.expr(f"cast(bin div {N_L} as int)").alias("r_bin"), (F.col("bin") % N_L).alias("mu_bin"), (F.col("a") / (F.col("a") + F.col("b"))).alias("s1"))
    return rows.select("r_bin", "mu_bin", F.col("s1").alias("weight")), rows.select("r_bin", "mu_bin", (1 - F.col("s1")).alias("weight"))


_JAC = f"""f AS ({pq.factors_sql(N_L)}), g AS ({pq.factors_sql(N_L, True)}), ws AS (SELECT bin // {N_L} AS r, bin % {N_L} AS m, s1, 1 - s1 AS s2 FROM sh),
p1 AS (SELECT (g.l // 2) * {N_R} + r AS i, (f.l // 2) * {N_R} + r AS o, sum(s1 * g.factor * f.factor) AS v FROM ws JOIN f ON f.mu_bin = m JOIN g ON g.mu_bin = m GROUP BY 1, 2),
p2 AS (SELECT (g.l // 2) * {N_R} + r AS i, (f.l // 2) * {N_R} + r AS o, sum(s2 * g.factor * f.factor) AS v FROM ws JOIN f ON f.mu_bin = m JOIN g ON g.mu_bin = m GROUP BY 1, 2)"""


@query(f"""WITH {_REG}, {_JAC}, u AS (SELECT x.o AS r, y.o AS c, a.value * x.v * y.v AS v FROM a JOIN p1 x ON a."row" = x.i JOIN p1 y ON a.col = y.i UNION ALL SELECT x.o, y.o, b.value * x.v * y.v FROM b JOIN p2 x ON b."row" = x.i JOIN p2 y ON b.col = y.i)
SELECT r::INTEGER AS "row", c::INTEGER AS col, round(sum(v), 9) AS value FROM u GROUP BY 1, 2""")
def combine_regions_legendre(spark, sf_dir):
    a, b, w1, w2 = regions(spark, sf_dir)
    f, g = multipoles.mu_factors(spark, N_L, 4), multipoles.mu_factors(spark, N_L, 4, inverse=True)
    s1, s2 = _legendre_shares(spark, w1, w2)
    return rounded(cov.regions_combined_legendre(a, b, cov.jacobian(s1, f, g, N_R), cov.jacobian(s2, f, g, N_R)), "value", digits=9)


@query(f"""WITH {MAT} SELECT ("row" % 4)::INTEGER AS "row", (col % 4)::INTEGER AS col, round(sum(value * [2.25, 3.0, 1.0]["row" // 4 + 1]::DOUBLE / 6.25 * [2.25, 3.0, 1.0][col // 4 + 1]::DOUBLE / 6.25), 9) AS value FROM mat GROUP BY 1, 2""")
def concat_tracers(spark, sf_dir):
    return rounded(cov.tracers_concatenated(matrix(spark, sf_dir), N // 3, (1.5, 1.0)), "value", digits=9)


@query(f'WITH {RAW} SELECT term, (subsample // 2)::INTEGER AS subsample, "row", col, round(avg(value), 9) AS value FROM raw GROUP BY term, subsample // 2, "row", col HAVING count(*) = 2')
def collapse_subsamples(spark, sf_dir):
    return rounded(cov.collapsed(raw(spark, sf_dir), 2), "value", digits=9)


@query(f"""WITH {RAW}, n AS (SELECT max(subsample) + 1 AS n FROM raw WHERE term <> 'c2') SELECT term, subsample, "row", col, round(value, 9) AS value FROM raw WHERE term <> 'c2' UNION ALL SELECT term, (subsample + n.n)::INTEGER, "row", col, round(value, 9) FROM raw, n WHERE term <> 'c2'""")
def concat_runs(spark, sf_dir):
    r = raw(spark, sf_dir)
    return rounded(cov.concatenated([r.where("term != 'c2'"), r]).select("term", "subsample", "row", "col", "value"), "value", digits=9)


@query(f"""WITH {RAW}, a AS (SELECT term, "row", col, avg(value) AS v FROM raw WHERE subsample <= 6 GROUP BY ALL), b AS (SELECT term, "row", col, avg(value) AS v FROM raw WHERE subsample < 6 GROUP BY ALL)
SELECT a.term, round(100 * sqrt(sum((a.v - b.v) * (a.v - b.v))) / sqrt(sum(a.v * a.v)), 9) AS change FROM a JOIN b ON a.term = b.term AND a."row" = b."row" AND a.col = b.col GROUP BY a.term""")
def frobenius_change(spark, sf_dir):
    return rounded(cov.frobenius_change(raw(spark, sf_dir), 6), "change", digits=9)


@query(f'WITH {RAW} SELECT term, "row", col, round(avg(value), 9) AS value FROM raw WHERE subsample < 4 GROUP BY ALL')
def first_subsamples(spark, sf_dir):
    return rounded(cov.full(cov.selected(raw(spark, sf_dir), 4)), "value", digits=9)


@query(f"WITH {RAW} SELECT term, count(DISTINCT subsample) AS n FROM raw GROUP BY term")
def term_completeness(spark, sf_dir):
    return cov.complete(raw(spark, sf_dir))


@query(f'WITH {RAW}, l AS (SELECT min(n) AS least FROM (SELECT term, count(DISTINCT subsample) AS n FROM raw GROUP BY term)) SELECT term, subsample, "row", col, round(value, 9) AS value FROM raw, l WHERE subsample < least')
def equalise_subsamples(spark, sf_dir):
    return rounded(cov.equalised(raw(spark, sf_dir)), "value", digits=9)


@query(f'WITH {RAW} SELECT (CASE WHEN subsample < 4 THEN 0 ELSE 1 END)::INTEGER AS half, term, "row", col, round(avg(value), 9) AS value FROM raw GROUP BY ALL')
def split_halves(spark, sf_dir):
    return rounded(cov.halves(raw(spark, sf_dir), 8), "value", digits=9)


@query(f'WITH {RAW} SELECT (subsample % 2)::INTEGER AS half, term, "row", col, round(avg(value), 9) AS value FROM raw GROUP BY ALL')
def split_odd_even(spark, sf_dir):
    return rounded(cov.halves(raw(spark, sf_dir), 8, alternate=True), "value", digits=9)
