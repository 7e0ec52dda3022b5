"""Queries of readers and writers: what is written is read back, and SQL says what it has to be."""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from galacov.operators import calibration, catalog, multipoles, pairs, sampler
from galacov.plans import fixtures as fx
from galacov.plans import matrix_queries as mq
from galacov.plans import pair_queries as pq
from galacov.plans.catalog_queries import rounded
from galacov.plans.registry import query
from galacov.sources import binning, scratch, tables


def lines(df, by: str, value, path: str, parts: int = 4) -> None:
    """Text files whose lines are in the order of a column."""
    df.repartitionByRange(parts, by).sortWithinPartitions(by).select(value.alias("value")).write.text(path)


def words(*cols):
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])


@query(f"""WITH {fx.PTS}, n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS k FROM pts)
SELECT k AS id, round(x * 0.5::DOUBLE, 9) AS x, round(y * 0.5::DOUBLE, 9) AS y, round(z * 0.5::DOUBLE, 9) AS z, CASE WHEN k >= 100 THEN -w ELSE w END AS w, jack FROM n WHERE k < 400""")
def particles_scan(spark, sf_dir):
    path = scratch.folder(spark, "particles")
    lines(fx.points(spark, sf_dir), "id", words("x", "y", "z", "w", "jack"), path)
    return rounded(tables.particles(spark, path, rescale=0.5, invert_after=100, limit=400), "x", "y", "z", digits=9)


@query(f"WITH {fx.SKY} SELECT id, ra, dec, z, nz AS w FROM sky WHERE (status & 3) = 3")
def sky_catalog_scan(spark, sf_dir):
    path = scratch.folder(spark, "sky")
    fx.sky(spark, sf_dir).select("id", F.col("ra").alias("RA"), F.col("dec").alias("DEC"), F.col("z").alias("Z"), F.col("status").alias("STATUS"), F.col("nz").alias("WEIGHT")).write.parquet(path)
    return tables.sky_catalog(spark.read.parquet(path), mask=3, keep=("id",))


@query("SELECT i::INTEGER AS bin, round(20 + 4 * i, 8)::DOUBLE AS r_lo, round(24 + 4 * i, 8)::DOUBLE AS r_hi FROM range(45) t(i)")
def binning_scan(spark, sf_dir):
    path = scratch.folder(spark, "bins")
    binning.write(binning.linear(spark, 20, 200, 45), path)
    return binning.read(spark, path)


@query("SELECT (1 + i)::DOUBLE AS s, 0.125::DOUBLE + 0.25::DOUBLE * j AS mu, ((i + 1) * (j + 1))::DOUBLE / 64 AS xi FROM range(12) a(i), range(4) b(j)")
def xi_table_scan(spark, sf_dir):
    path = scratch.folder(spark, "xi")
    r, mu = np.arange(1.0, 13.0), 0.125 + 0.25 * np.arange(4)
    tables.write_text(spark, path, tables.xi_text(r, mu, np.outer(np.arange(1, 13), np.arange(1, 5)) / 64))
    return tables.xi_table(spark, path)


@query("SELECT label::INTEGER AS jack, (vec_id % 6)::INTEGER AS bin, count(*)::DOUBLE / 8 AS weight FROM embeddings GROUP BY 1, 2")
def jackknife_weights_scan(spark, sf_dir):
    path = scratch.folder(spark, "weights")
    e = fx.read(spark, sf_dir, "embeddings")
    wide = e.groupBy("label").agg(*[(F.count(F.when(F.col("vec_id") % 6 == k, 1)) / 8).alias(f"w{k}") for k in range(6)])
    lines(wide, "label", words("label", *[f"w{k}" for k in range(6)]), path)
    return tables.wide(spark, path).where("weight > 0")


@query("SELECT (vec_id)::INTEGER AS bin, k::INTEGER AS k, round(embedding[k + 1]::DOUBLE, 6) AS value FROM embeddings, range(7) t(k) WHERE vec_id < 40")
def correction_coefficients_scan(spark, sf_dir):
    path = scratch.folder(spark, "coefficients")
    e = fx.read(spark, sf_dir, "embeddings").where("vec_id < 40").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"a{k}") for k in range(7)])
    lines(e, "vec_id", words(*[f"a{k}" for k in range(7)]), path)
    return rounded(tables.coefficients(spark, path).select("bin", F.posexplode("coef").alias("k", "value")), "value")


@query("SELECT (row_number() OVER (ORDER BY bin) - 1)::INTEGER AS bin, rr FROM (SELECT vec_id % 30 AS bin, count(*)::DOUBLE / 4 AS rr FROM embeddings GROUP BY 1)")
def pair_counts_scan(spark, sf_dir):
    """One number a line, in the order of the bins."""
    path = scratch.folder(spark, "counts")
    lines(fx.read(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 30).alias("bin")).agg((F.count("*") / 4).alias("rr")), "bin", words("rr"), path)
    return tables.column(spark, path)


@query(f"SELECT mu_bin, l, round(factor, 9) AS factor FROM ({pq.factors_sql(6)})")
def mu_bin_factors_scan(spark, sf_dir):
    path = scratch.folder(spark, "factors")
    wide = multipoles.mu_factors(spark, 6, 4).groupBy("mu_bin").pivot("l", [0, 2, 4]).agg(F.first("factor"))
    lines(wide, "mu_bin", words("0", "2", "4"), path, 2)
    return rounded(tables.mu_factor_table(spark, path, 6, 4), "factor", digits=9)


@query(f"""WITH {mq.RAW} SELECT term, '11,11' AS tracers, subsample, "row", CASE term WHEN 'c2' THEN 0 ELSE col END AS col, round(value, 9) AS value FROM raw WHERE term <> 'c2' OR "row" = col""")
def raw_matrices_scan(spark, sf_dir):
    """Text matrices by term and subsample, c2 by its diagonal."""
    folder = scratch.folder(spark, "matrices")
    tables.write_matrices(mq.raw(spark, sf_dir), folder, mq.N_R, f"l{2 * mq.N_L - 2}")
    return rounded(tables.text_matrices(spark, folder).where("value != 0"), "value", digits=9)


@query(f"""WITH {mq.RAW} SELECT term, subsample, "row", col, value FROM raw WHERE term IN ('c2', 'c4') AND subsample < 3""")
def partitioned_terms_scan(spark, sf_dir):
    path = scratch.folder(spark, "terms")
    tables.write_terms(mq.raw(spark, sf_dir), path)
    return tables.read_terms(spark, path, ["c2", "c4"], 3).select("term", "subsample", "row", "col", "value")


def exported(spark, sf_dir, **how):
    """A stored result, exported and read again."""
    with tempfile.TemporaryDirectory() as d:  # results are the driver's: as many rows as bins
        cov = calibration.matrix(mq.matrix(spark, sf_dir), mq.N)
        np.savez(os.path.join(d, "r.npz"), full_theory_covariance=cov, full_theory_D_matrix=np.eye(mq.N) / 64, shot_noise_rescaling=np.array([1.25, 0.75]))
        tables.export_result(os.path.join(d, "r.npz"), os.path.join(d, "out.txt"), tell=lambda x: None, **how)
        got, alphas = tables.read_covariance(os.path.join(d, "out.txt"))
    rows = calibration.table(spark, got).where("value != 0")
    return rounded(rows.select("row", "col", "value", F.lit(alphas[0]).alias("alpha1"), F.lit(alphas[1]).alias("alpha2")), "value", digits=9)


_EXPORT = """SELECT {r} AS "row", {c} AS col, round(value, 9) AS value, 1.25::DOUBLE AS alpha1, 0.75::DOUBLE AS alpha2 FROM mat {w}"""


@query(f"WITH {mq.MAT} " + _EXPORT.format(r='"row"', c="col", w=""))
def covariance_export(spark, sf_dir):
    return exported(spark, sf_dir)


_TURN = "((({0} % 3) * 4 + {0} // 3))::INTEGER"


@query(f"WITH {mq.MAT} " + _EXPORT.format(r=_TURN.format('"row"'), c=_TURN.format("col"), w=""))
def covariance_export_legendre(spark, sf_dir):
    return exported(spark, sf_dir, max_l=4)


@query(f"WITH {mq.MAT} " + _EXPORT.format(r='("row" - 4)::INTEGER', c="(col - 4)::INTEGER", w='WHERE "row" BETWEEN 4 AND 7 AND col BETWEEN 4 AND 7'))
def covariance_export_cross(spark, sf_dir):
    return exported(spark, sf_dir, tracers=2, cross=True)


_PART = "(({0} // 4) * 4 + ({0} % 2) * 2 + ({0} % 4) // 2)::INTEGER"


@query(f"WITH {mq.MAT} " + _EXPORT.format(r=_PART.format('"row"'), c=_PART.format("col"), w=""))
def covariance_export_legendre_multi(spark, sf_dir):
    """(tracers, r, l) to (tracers, l, r), two radial bins of two multipoles."""
    return exported(spark, sf_dir, max_l=2, tracers=2)


@query(f"WITH {mq.MAT} " + _EXPORT.format(r=f"({_PART.format(chr(34) + 'row' + chr(34))} - 4)::INTEGER", c=f"({_PART.format('col')} - 4)::INTEGER", w='WHERE "row" BETWEEN 4 AND 7 AND col BETWEEN 4 AND 7'))
def covariance_export_legendre_cross(spark, sf_dir):
    return exported(spark, sf_dir, max_l=2, tracers=2, cross=True)


@query("SELECT i::INTEGER AS run, 1 + i::DOUBLE / 8 AS alpha1, 1 - i::DOUBLE / 16 AS alpha2 FROM range(5) t(i)")
def rescalings_scan(spark, sf_dir):
    with tempfile.TemporaryDirectory() as d:
        paths = [os.path.join(d, f"{i}.npz") for i in range(5)]
        for i, p in enumerate(paths):
            np.savez(p, shot_noise_rescaling=np.array([1 + i / 8, 1 - i / 16]))
        rows = [(i, *a) for i, a in enumerate(tables.rescalings(paths))]
    return spark.createDataFrame(rows, "run int, alpha1 double, alpha2 double")


@query("SELECT (i // 9 - 1)::INTEGER AS dx, ((i // 3) % 3 - 1)::INTEGER AS dy, (i % 3 - 1)::INTEGER AS dz, (i + 1)::DOUBLE / 512 AS p FROM range(27) t(i)")
def kernel_scan(spark, sf_dir):
    """Probabilities of cell offsets, saved and loaded."""
    path = scratch.folder(spark, "kernel")
    tables.write_kernel(spark, path, (sampler.offsets(1), np.arange(1, 28) / 512), 12.5)
    d, p = tables.read_kernel(spark, path, 1)
    return spark.createDataFrame([(*map(int, o), float(v)) for o, v in zip(d, p, strict=True)], "dx int, dy int, dz int, p double")


@query(f"""WITH {fx.PTS}, s AS (SELECT id, x, y, z, sqrt(x * x + y * y + z * z) AS r FROM pts)
SELECT kind, id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM s, (VALUES ('xyz'), ('pos'), ('rdd')) k(kind)""")
def position_formats(spark, sf_dir):
    p = fx.points(spark, sf_dir).select("id", "x", "y", "z")
    ra, dec, r = catalog.cartesian_to_sky(F.col("x"), F.col("y"), F.col("z"))
    forms = {"xyz": p, "pos": p.select("id", F.array("x", "y", "z").alias("pos")), "rdd": p.select("id", ra.alias("ra"), dec.alias("dec"), r.alias("distance"))}
    out = None
    for kind, table in forms.items():
        part = catalog.positions(table, kind).select(F.lit(kind).alias("kind"), "id", "x", "y", "z")
        out = part if out is None else out.unionByName(part)
    return rounded(out, "x", "y", "z")


@query(f"WITH {fx.SKY} SELECT id, 1.0::DOUBLE AS w FROM sky")
def unit_weights(spark, sf_dir):
    return catalog.weighted(fx.sky(spark, sf_dir)).select("id", "w")


@query(f"""WITH {fx.PTS}, a AS (SELECT DISTINCT jack FROM pts WHERE is_data), b AS (SELECT DISTINCT jack FROM pts WHERE NOT is_data), c AS (SELECT DISTINCT jack FROM pts WHERE jack < 3)
SELECT (SELECT count(*) FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))) = 0 AS catalogs, (SELECT count(*) FROM ((SELECT * FROM a EXCEPT SELECT * FROM c) UNION ALL (SELECT * FROM c EXCEPT SELECT * FROM a))) = 0 AS others""")
def label_sets_equal(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    data, random = p.where("is_data"), p.where("not is_data")
    return spark.createDataFrame([(catalog.same_labels(data, random), catalog.same_labels(data, p.where("jack < 3")))], "catalogs boolean, others boolean")


@query("SELECT (event_id % 4)::INTEGER AS r_bin, ((event_id // 4) % 3)::INTEGER AS mu_bin, count(*) AS npairs, sum((event_id % 16)::DOUBLE / 16) AS wpairs FROM events GROUP BY 1, 2")
def summed_counts(spark, sf_dir):
    """Counts of all realizations added by bin."""
    e = fx.read(spark, sf_dir, "events")
    each = e.groupBy("user_id", (F.col("event_id") % 4).cast("int").alias("r_bin"), F.expr("cast((event_id div 4) % 3 as int)").alias("mu_bin")).agg(F.count("*").alias("npairs"), F.sum(F.col("event_id") % 16 / 16).alias("wpairs"))
    return pairs.summed(each, ["npairs", "wpairs"])
