"""Queries of catalog operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from galacov.functions import geometry
from galacov.operators import catalog
from galacov.plans import fixtures as fx
from galacov.plans.registry import query


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(f"WITH {fx.SKY} SELECT id, ra, dec, z FROM sky WHERE z >= 0.1 AND z < 0.5")
def catalog_cut(spark, sf_dir):
    return catalog.redshift_cut(fx.sky(spark, sf_dir), 0.1, 0.5).select("id", "ra", "dec", "z")


@query(f"WITH {fx.SKY} SELECT id, status FROM sky WHERE (status & 5) = 5")
def status_mask(spark, sf_dir):
    return catalog.status_mask(fx.sky(spark, sf_dir), 5).select("id", "status")


@query(f"WITH {fx.SKY} SELECT id, round(1 / (1 + 10000.0::DOUBLE * nz), 9) AS w FROM sky")
def fkp_weight(spark, sf_dir):
    return rounded(catalog.weighted(fx.sky(spark, sf_dir), fkp=catalog.parse_fkp("10000,nz")).select("id", "w"), "w", digits=9)


@query(f"WITH {fx.PTS} SELECT id, round(w / (SELECT sum(w) FROM pts), 9) AS w FROM pts")
def normalize_weights(spark, sf_dir):
    return rounded(catalog.normalised(fx.points(spark, sf_dir)).select("id", "w"), "w", digits=9)


_SIGNED = "CASE WHEN is_data THEN w ELSE -w END"


@query(f"""WITH {fx.PTS}, v AS (SELECT id, {_SIGNED} AS w FROM pts), t AS (SELECT sum(w) FILTER (w > 0) AS p, sum(w) FILTER (w < 0) AS n FROM v)
SELECT id, round(CASE WHEN w < 0 THEN w * (-p / n) ELSE w END, 9) AS w FROM v, t""")
def balance_weights(spark, sf_dir):
    p = fx.points(spark, sf_dir).withColumn("w", F.when(F.col("is_data"), F.col("w")).otherwise(-F.col("w")))
    return rounded(catalog.balanced(p).select("id", "w"), "w", digits=9)


@query(f"WITH {fx.PTS} SELECT id, -w AS w FROM pts")
def invert_weights(spark, sf_dir):
    return catalog.inverted(fx.points(spark, sf_dir)).select("id", "w")


@query(f"WITH {fx.PTS} SELECT id, x * 0.5 AS x, y * 0.5 AS y, z * 0.5 AS z FROM pts")
def rescale_coordinates(spark, sf_dir):
    return catalog.rescaled(fx.points(spark, sf_dir), 0.5).select("id", "x", "y", "z")


@query(f"""WITH {fx.SKY}, a AS (SELECT id, radians(90 - dec) AS t, radians(ra) AS p, z * 3000 AS d FROM sky)
SELECT id, round(d * sin(t) * cos(p), 6) AS x, round(d * sin(t) * sin(p), 6) AS y, round(d * cos(t), 6) AS z FROM a""")
def sky_to_cartesian(spark, sf_dir):
    s = fx.sky(spark, sf_dir).withColumn("distance", F.col("z") * 3000)
    x, y, z = catalog.sky_to_cartesian(F.col("ra"), F.col("dec"), F.col("distance"))
    return rounded(s.select("id", x.alias("x"), y.alias("y"), z.alias("z")), "x", "y", "z")


@query(f"""WITH {fx.PTS}, a AS (SELECT id, degrees(atan2(y, x)) AS ra, z, sqrt(x * x + y * y + z * z) AS r FROM pts)
SELECT id, round(CASE WHEN ra < 0 THEN ra + 360 ELSE ra END, 6) AS ra, round(90 - degrees(acos(z / r)), 6) AS dec, round(r, 6) AS distance FROM a""")
def cartesian_to_sky(spark, sf_dir):
    ra, dec, r = catalog.cartesian_to_sky(F.col("x"), F.col("y"), F.col("z"))
    return rounded(fx.points(spark, sf_dir).select("id", ra.alias("ra"), dec.alias("dec"), r.alias("distance")), "ra", "dec", "distance")


#: Simpson's rule over 64 steps in log(1 + z).
_DISTANCE = """d AS (SELECT id, ra, dec, z, 2997.92458::DOUBLE * h / 3 * sum(f * exp(i * h) / sqrt(0.31::DOUBLE * exp(3 * i * h) + 0.69::DOUBLE)) AS r
  FROM (SELECT *, ln(1 + z) / 64 AS h, CASE WHEN i IN (0, 64) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS f FROM sky, range(65) t(i)) GROUP BY id, ra, dec, z, h)"""


@query(f"""WITH {fx.SKY}, {_DISTANCE} SELECT id, round(r * cos(radians(dec)) * cos(radians(ra)), 3) + 0.0 AS x, round(r * cos(radians(dec)) * sin(radians(ra)), 3) + 0.0 AS y, round(r * sin(radians(dec)), 3) + 0.0 AS z FROM d""")
def comoving_positions(spark, sf_dir):
    found = catalog.sky_catalog_to_xyz(fx.sky(spark, sf_dir).drop("nz", "status"))
    return found.select("id", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in "xyz"])


@query(f"WITH {fx.PTS} SELECT id, x, y, z FROM pts ORDER BY ('0x' || substr(md5('subset|' || id::VARCHAR), 1, 8))::BIGINT, id LIMIT 100")
def subset_n(spark, sf_dir):
    return catalog.subset(fx.points(spark, sf_dir), 100).select("id", "x", "y", "z")


@query(f"WITH {fx.PTS} SELECT id, half FROM pts")
def half_split(spark, sf_dir):
    return fx.points(spark, sf_dir).select("id", "half")


@query(f"WITH {fx.PTS} SELECT min(x) AS x_min, min(y) AS y_min, min(z) AS z_min, max(x) - min(x) AS x_size, max(y) - min(y) AS y_size, max(z) - min(z) AS z_size FROM pts")
def bounding_box(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    return catalog.bounding_box([p.where("tracer = 1"), p.where("tracer = 2")])


_CELLS = f"{fx.PTS}, cel AS (SELECT *, floor(x / 50)::BIGINT AS cx, floor(y / 50)::BIGINT AS cy, floor(z / 50)::BIGINT AS cz FROM pts)"


@query(f"""WITH {_CELLS} SELECT cx, cy, cz, count(*) AS np, count(*) FILTER (half = 0) AS np1, count(*) FILTER (half = 1) AS np2,
  sum(CASE WHEN w >= 0 THEN w ELSE 0 END) AS w_pos, sum(CASE WHEN w < 0 THEN w ELSE 0 END) AS w_neg FROM cel GROUP BY cx, cy, cz""")
def cell_histogram(spark, sf_dir):
    return catalog.histogram(catalog.cells(fx.points(spark, sf_dir), 50))


@query(f"""WITH {_CELLS}, f AS (SELECT cx, cy, cz, count(*) AS np FROM cel GROUP BY cx, cy, cz),
s AS (SELECT *, coalesce(sum(np) OVER (ORDER BY cx, cy, cz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM f)
SELECT c.id, c.cx, c.cy, c.cz, (row_number() OVER (PARTITION BY c.cx, c.cy, c.cz ORDER BY c.id) - 1)::INTEGER AS pos, s.np, s.start FROM cel c JOIN s USING (cx, cy, cz)""")
def cell_csr_offsets(spark, sf_dir):
    return catalog.numbered(catalog.cells(fx.points(spark, sf_dir).select("id", "x", "y", "z"), 50)).select("id", "cx", "cy", "cz", "pos", "np", "start")


@query(f"""WITH {fx.PTS}, c AS (SELECT floor(x / 50) AS cx, floor(y / 50) AS cy, floor(z / 50) AS cz, count(*) AS n FROM pts GROUP BY 1, 2, 3)
SELECT count(*) AS filled, round(avg(n), 6) AS mean FROM c""")
def cell_density(spark, sf_dir):
    c = catalog.cells(fx.points(spark, sf_dir), 50).groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("filled"), F.round(F.avg("n"), 6).alias("mean"))


def _healpix_sql(n: int) -> str:
    half_pi = repr(math.pi / 2)
    return f"""WITH {fx.PTS}, a AS (SELECT id, z / sqrt(x * x + y * y + z * z) AS c, atan2(y, x) / {half_pi} AS q FROM pts),
b AS (SELECT id, c, q - 4 * floor(q / 4) AS tt, {n} * sqrt(3 * (1 - abs(c))) AS rest FROM a),
d AS (SELECT *, tt - floor(tt) AS tp, floor({n} * (0.5 + tt) - {n} * 0.75 * c)::BIGINT AS up, floor({n} * (0.5 + tt) + {n} * 0.75 * c)::BIGINT AS down FROM b),
e AS (SELECT *, {n} + 1 + up - down AS ring, floor(tp * rest)::BIGINT + floor((1 - tp) * rest)::BIGINT + 1 AS cap FROM d)
SELECT id, CASE WHEN abs(c) <= 2.0 / 3 THEN 2 * {n} * ({n} - 1) + (ring - 1) * {4 * n} + (floor((up + down - {n} + CASE WHEN ring % 2 = 0 THEN 1 ELSE 0 END + 1) / 2)::BIGINT % {4 * n} + {4 * n}) % {4 * n}
  WHEN c > 0 THEN 2 * cap * (cap - 1) + floor(tt * cap)::BIGINT % (4 * cap) ELSE {12 * n * n} - 2 * cap * (cap + 1) + floor(tt * cap)::BIGINT % (4 * cap) END AS pixel FROM e"""


@query(_healpix_sql(8))
def healpix_label(spark, sf_dir):
    return fx.points(spark, sf_dir).select("id", catalog.healpix_ring(F.col("x"), F.col("y"), F.col("z"), 8).alias("pixel"))


@query(f"""WITH {fx.PTS}, c AS (SELECT jack, avg(x) AS ux, avg(y) AS uy, avg(z) AS uz FROM pts GROUP BY jack),
n AS (SELECT jack, ux / sqrt(ux * ux + uy * uy + uz * uz) AS ux, uy / sqrt(ux * ux + uy * uy + uz * uz) AS uy, uz / sqrt(ux * ux + uy * uy + uz * uz) AS uz FROM c)
SELECT p.id, arg_max(n.jack, round((n.ux * p.x + n.uy * p.y + n.uz * p.z) / sqrt(p.x * p.x + p.y * p.y + p.z * p.z), 12))::INTEGER AS jack FROM pts p, n GROUP BY p.id""")
def nearest_region(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    c = p.groupBy("jack").agg(F.avg("x").alias("ux"), F.avg("y").alias("uy"), F.avg("z").alias("uz"))
    r = geometry.separation(F.col("ux"), F.col("uy"), F.col("uz"))
    c = c.select("jack", (F.col("ux") / r).alias("ux"), (F.col("uy") / r).alias("uy"), (F.col("uz") / r).alias("uz"))
    return catalog.nearest_region(p.drop("jack"), c).select("id", "jack")


@query()
def kmeans_regions(spark, sf_dir):
    return catalog.kmeans_regions(fx.points(spark, sf_dir).drop("jack"), 12).select("id", "jack")


@query("SELECT vec_id AS id, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS jack FROM embeddings")
def jackknife_ids(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    return catalog.compact_jackknives(p, p.select("jack")).select("id", "jack")


@query("SELECT i AS id, ('0x' || substr(md5('uniform-x|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 100 AS x, ('0x' || substr(md5('uniform-y|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 100 AS y, ('0x' || substr(md5('uniform-z|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 100 AS z, 1.0::DOUBLE AS w FROM range(1000) t(i)")
def uniform_points(spark, sf_dir):
    return catalog.uniform_points(spark, 1000, 100.0)


@query("SELECT i::INTEGER AS bin, CASE WHEN i = 0 THEN greatest(0.0, 1e-4) ELSE 0.0 + i * 10.0 END::DOUBLE AS r_lo, (0.0 + (i + 1) * 10.0)::DOUBLE AS r_hi FROM range(20) t(i)")
def linear_bins(spark, sf_dir):
    from galacov.sources import binning

    return binning.linear(spark, 0.0, 200.0, 20)


@query("SELECT i::INTEGER AS bin, round(pow(10, i / 10.0::DOUBLE), 9) AS r_lo, round(pow(10, (i + 1) / 10.0::DOUBLE), 9) AS r_hi FROM range(20) t(i)")
def log_bins(spark, sf_dir):
    from galacov.sources import binning

    return rounded(binning.logarithmic(spark, 1.0, 100.0, 20), "r_lo", "r_hi", digits=9)


@query("""SELECT i::INTEGER AS bin, round(pow(10, i / 5.0::DOUBLE), 9) AS r_lo, round(pow(10, (i + 1) / 5.0::DOUBLE), 9) AS r_hi FROM range(5) t(i)
UNION ALL SELECT (i + 5)::INTEGER, 10.0 + i * 10.0, 10.0 + (i + 1) * 10.0 FROM range(9) t(i)""")
def hybrid_bins(spark, sf_dir):
    from galacov.sources import binning

    return rounded(binning.hybrid(spark, 1.0, 100.0, 10.0, 5, 9), "r_lo", "r_hi", digits=9)
