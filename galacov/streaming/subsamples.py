"""Running sums of raw terms as finished batches of loops arrive. An extra: the terms are sums, so a stream keeps them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_means(stream: DataFrame) -> DataFrame:
    """term, row, col, value, n from a stream of (term, subsample, row, col, value); for output mode complete or update."""
    return stream.groupBy("term", "row", "col").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def watch(spark, folder: str, schema: str, name: str, checkpoint: str):
    """A query that keeps the means of Parquet files that appear in a folder, in a table in memory."""
    files = spark.readStream.schema(schema).parquet(folder)
    return running_means(files).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
