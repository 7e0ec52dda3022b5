"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether Spark removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of whole texts, or of their words, that go to Python at once.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
#: Folder for sessions that name none (tests, a single machine); made once in a process.
_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset and all
    tasks run in this process."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master") or ""):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="galacov-"))
    return f"file://{_own_root[0]}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_root(spark)}/galacov-{uuid.uuid4().hex}-{name}"


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, so a lost executor costs only
    the tasks that were reading it. The shuffle files behind the write go once it is done."""
    spark = df.sparkSession
    path = path or fresh_dir(spark, name)
    before = {k: spark.conf.get(k, d) for k, d in ((CLEANUP, "false"), (BATCH, "10000"))}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(min(ROWS, int(before[BATCH])) if int(before[BATCH]) > 0 else ROWS))
    try:
        # Whoever reads the table got its path from a write that ended, so no file has to say so.
        df.write.mode("errorifexists").option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def trimmed() -> None:
    """Give back what a task's arrays took: Python workers live on, beside the next stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends at most ROWS rows to Python at once: whole texts are long."""
    now = int(spark.conf.get(BATCH, "10000"))
    if now <= 0 or now > ROWS:
        spark.conf.set(BATCH, str(ROWS))


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def private(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of df has."""
    taken, tail = {c.lower() for c in df.columns}, ""
    while any(f"__{n}{tail}".lower() in taken for n in names):
        tail += "_"
    return [f"__{n}{tail}" for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
