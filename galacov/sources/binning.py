"""Radial binnings: made, written and read."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The first edge of a binning that would start at 0.
FLOOR = 1e-4
SCHEMA = "r_lo double, r_hi double"


def linear(spark, low: float, high: float, n: int) -> DataFrame:
    """bin, r_lo, r_hi."""
    step = (high - low) / n
    edge = lambda i: F.lit(float(low)) + i * F.lit(step)
    lo = F.when(F.col("id") == 0, F.greatest(edge(F.col("id")), F.lit(FLOOR))).otherwise(edge(F.col("id")))
    return spark.range(n).select(F.col("id").cast("int").alias("bin"), lo.alias("r_lo"), edge(F.col("id") + 1).alias("r_hi"))


def logarithmic(spark, low: float, high: float, n: int) -> DataFrame:
    if low <= 0:
        raise ValueError("logarithmic bins start above 0")
    step = math.log10(high / low) / n
    edge = lambda i: F.pow(F.lit(10.0), F.lit(math.log10(low)) + i * F.lit(step))
    return spark.range(n).select(F.col("id").cast("int").alias("bin"), edge(F.col("id")).alias("r_lo"), edge(F.col("id") + 1).alias("r_hi"))


def hybrid(spark, low: float, high: float, cut: float, n_log: int, n_linear: int) -> DataFrame:
    """Logarithmic to the cut, linear from there."""
    tail = linear(spark, cut, high, n_linear).withColumn("bin", (F.col("bin") + n_log).cast("int"))
    return logarithmic(spark, low, cut, n_log).unionByName(tail)


def write(bins: DataFrame, path: str) -> None:
    """Two columns of text, one file, in order of the bins."""
    bins.orderBy("bin").select(F.format_string("%.8f %.8f", "r_lo", "r_hi").alias("value")).coalesce(1).write.text(path)


def read(spark, path: str) -> DataFrame:
    """bin, r_lo, r_hi; rows that are not two numbers are an error."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parts = F.split(F.trim("value"), r"\s+")
    two = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("not two columns: "), F.col("value"))).cast("array<string>"))
    rows = lines.select(two.alias("p")).select(F.col("p")[0].cast("double").alias("r_lo"), F.col("p")[1].cast("double").alias("r_hi")).orderBy("r_lo").collect()  # a handful of bins
    return spark.createDataFrame([(i, r["r_lo"], r["r_hi"]) for i, r in enumerate(rows)], "bin int, r_lo double, r_hi double")


def edges(bins: DataFrame) -> tuple[tuple[float, float], ...]:
    return tuple((r["r_lo"], r["r_hi"]) for r in bins.orderBy("bin").collect())
