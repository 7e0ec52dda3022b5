"""Catalogs made from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galacov.operators import catalog
from galacov.operators.pairs import Bins

BINS = Bins(((10.0, 25.0), (25.0, 40.0)), n_mu=3)
#: Cutoff of the correlation function, its amplitude, and points for each galaxy.
XI_CUT, XI_AMPLITUDE, NORM = 50.0, 400.0, 8.0
BOX = 400.0


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark, sf_dir: str) -> DataFrame:
    """id, x, y, z, w (eighths), jack, tracer, is_data, half."""
    e = read(spark, sf_dir, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double") * 1000 + 2000
    out = e.select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), (1 + F.col("label") * 0.125).alias("w"), F.col("label").cast("int").alias("jack"),
                   (F.col("vec_id") % 2 + 1).cast("int").alias("tracer"), (F.col("vec_id") % 4 == 0).alias("is_data"))
    return catalog.half(out)


def sky(spark, sf_dir: str) -> DataFrame:
    """id, ra, dec, z, nz, status."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 360).cast("double").alias("ra"), (F.col("event_id") % 121 - 60).cast("double").alias("dec"), (F.col("value") / 200).alias("z"),
                    ((F.col("event_id") % 8 + 1) / 1024).alias("nz"), F.get_json_object("props", "$.k").cast("int").alias("status"))


def xi(s, mu):
    """A power law, of columns or arrays."""
    return XI_AMPLITUDE / (s * s)


PTS = """pts AS (
  SELECT vec_id AS id, embedding[1]::DOUBLE * 1000 + 2000 AS x, embedding[2]::DOUBLE * 1000 + 2000 AS y, embedding[3]::DOUBLE * 1000 + 2000 AS z,
         1 + label * 0.125::DOUBLE AS w, label::INTEGER AS jack, (vec_id % 2 + 1)::INTEGER AS tracer, vec_id % 4 = 0 AS is_data,
         (('0x' || substr(md5('half|' || vec_id::VARCHAR), 1, 8))::BIGINT % 2)::INTEGER AS half
  FROM embeddings
)"""
SKY = """sky AS (
  SELECT event_id AS id, (user_id % 360)::DOUBLE AS ra, (event_id % 121 - 60)::DOUBLE AS dec, value / 200 AS z,
         (event_id % 8 + 1)::DOUBLE / 1024 AS nz, json_extract_string(props, '$.k')::INTEGER AS status
  FROM events
)"""


def pairs_sql(name: str, left: str, right: str, r_min: float, r_max: float, where: str = "a.id <> b.id", box: float | None = None) -> str:
    """A table of pairs by comparing all points."""
    if box:
        image = lambda c: f"((a.{c} - b.{c}) - {box} * round((a.{c} - b.{c}) / {box}))"
        mu = "abs(dz) / s"
    else:
        image = lambda c: f"(a.{c} - b.{c})"
        mu = "abs(dx * mx + dy * my + dz * mz) / (sqrt(dx * dx + dy * dy + dz * dz) * sqrt(mx * mx + my * my + mz * mz))"
    return f"""{name} AS (
  SELECT id1, id2, w1, w2, jack1, jack2, half1, half2, tracer1, tracer2, s, {mu} AS mu FROM (
    SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS s FROM (
      SELECT a.id AS id1, b.id AS id2, a.w AS w1, b.w AS w2, a.jack AS jack1, b.jack AS jack2, a.half AS half1, b.half AS half2, a.tracer AS tracer1, b.tracer AS tracer2,
             {image('x')} AS dx, {image('y')} AS dy, {image('z')} AS dz, a.x + b.x AS mx, a.y + b.y AS my, a.z + b.z AS mz
      FROM {left} a JOIN {right} b ON {where} AND abs({image('x')}) < {r_max} AND abs({image('y')}) < {r_max} AND abs({image('z')}) < {r_max}))
  WHERE s > 0 AND s >= {r_min} AND s < {r_max}
)"""


def bin_sql(bins: Bins = BINS, prefix: str = "") -> tuple[str, str]:
    """Expressions of the radial bin and of the bin of mu."""
    r = "CASE " + " ".join(f"WHEN {prefix}s >= {lo} AND {prefix}s < {hi} THEN {i}" for i, (lo, hi) in enumerate(bins.edges)) + " END"
    return r, f"least(floor(({prefix}mu - {bins.mu_low}) / ({bins.mu_high - bins.mu_low}::DOUBLE / {bins.n_mu}))::INTEGER, {bins.n_mu - 1})"


def binned_sql(name: str, source: str, bins: Bins = BINS) -> str:
    r, m = bin_sql(bins)
    return f"{name} AS (SELECT *, r_bin * {bins.n_mu} + mu_bin AS bin FROM (SELECT *, {r} AS r_bin, {m} AS mu_bin FROM {source}) WHERE r_bin IS NOT NULL)"


def grid_sql(bins: Bins = BINS) -> str:
    return f"grid AS (SELECT (i // {bins.n_mu})::INTEGER AS r_bin, (i % {bins.n_mu})::INTEGER AS mu_bin FROM range({len(bins.edges) * bins.n_mu}) t(i))"
