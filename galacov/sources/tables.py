"""Readers and writers of catalogs, correlation tables, counts, weights, raw terms and results."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_lines(spark, path: str, comments: bool = True) -> DataFrame:
    """id (0, 1, ...) and value of the lines that are not blank (nor begin with '#'), in the order of the text: files by
    name, and each file from its beginning, however Spark deals its splits. A row for each split comes to the driver."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    trimmed = F.trim("value")
    lines = lines.where((F.length(trimmed) > 0) & (~F.startswith(trimmed, F.lit("#")) if comments else F.lit(True)))
    # Rows of a split are read one after another by one task, so their ids have no gaps.
    lines = lines.withColumn("m", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "start").agg(F.min("m").alias("m0"), F.count("*").alias("n")).orderBy("file", "start").collect()
    rows, offset = [], 0
    for r in splits:
        rows.append((r["file"], r["start"], r["m0"], offset))
        offset += r["n"]
    table = spark.createDataFrame(rows, "file string, start long, m0 long, offset long")
    return lines.join(F.broadcast(table), ["file", "start"]).select((F.col("m") - F.col("m0") + F.col("offset")).alias("id"), "value")


def particles(spark, path: str, rescale: float = 1.0, invert_after: int | None = None, limit: int | None = None) -> DataFrame:
    """x, y, z, w, jack, id from white-space text of 4 or 5 columns; '#' and blank lines are skipped, fewer than 4 numbers
    are an error. From row `invert_after` on, weights change sign. Rows are numbered in the order of the text."""
    p = F.split(F.trim("value"), r"\s+")
    four = F.when(F.size(p) >= 4, p).otherwise(F.raise_error(F.concat(F.lit("fewer than 4 numbers: "), F.col("value"))).cast("array<string>"))
    rows = ordered_lines(spark, path).select("id", four.alias("p"))
    w = F.col("p")[3].cast("double")
    if invert_after is not None:
        w = F.when(F.col("id") >= invert_after, -w).otherwise(w)
    out = rows.select(*[(F.col("p")[i].cast("double") * rescale).alias(c) for i, c in enumerate("xyz")], w.alias("w"), F.get(F.col("p"), F.lit(4)).cast("double").cast("int").alias("jack"), "id")
    return out if limit is None else out.where(F.col("id") < limit)


def sky_catalog(df: DataFrame, weight: str | None = "WEIGHT", fkp=False, mask: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """ra, dec, z, w of a survey table with columns RA, DEC, Z, and the columns to keep; status bits as asked."""
    from galacov.operators import catalog

    out = catalog.status_mask(df, mask, "STATUS") if mask else df
    out = catalog.weighted(out, weight if weight in df.columns else None, fkp, "WEIGHT_FKP")
    return out.select(*keep, F.col("RA").cast("double").alias("ra"), F.col("DEC").cast("double").alias("dec"), F.col("Z").cast("double").alias("z"), "w")


# ---- correlation tables ----------------------------------------------------------------------------------------------
def xi_text(r, mu, xi) -> str:
    """Two header lines of nodes, then a row for each r."""
    return "".join(" ".join(f"{v:.8e}" for v in np.atleast_1d(row)) + "\n" for row in (r, mu, *np.asarray(xi)))


def write_xi(path: str, r, mu, xi) -> None:
    with open(path, "w") as f:
        f.write(xi_text(r, mu, xi))


def xi_of(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, mu, xi = rows[0], rows[1], np.array(rows[2:])
    if xi.shape != (len(r), len(mu)):
        raise ValueError(f"{xi.shape} values for {len(r)} x {len(mu)} nodes")
    return r, mu, xi


def read_xi(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with open(path) as f:
        return xi_of([np.array(line.split(), float) for line in f if line.strip()])


def xi_table(spark, path: str) -> DataFrame:
    """s, mu, xi in long form, from any file system that Spark knows."""
    r, mu, xi = xi_of([np.array(x["values"], float) for x in rows_of(spark, path).orderBy("bin").collect()])  # a row a node
    return spark.createDataFrame([(float(a), float(b), float(xi[i, j])) for i, a in enumerate(r) for j, b in enumerate(mu)], "s double, mu double, xi double")


# ---- matrices by row -------------------------------------------------------------------------------------------------
def wide(spark, path: str, first: str = "jack", value: str = "weight") -> DataFrame:
    """first, bin, value from rows of a label and one number for each bin; a row of another length is an error."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(p.alias("p"))
    width = rows.agg(F.min(F.size("p")).alias("lo"), F.max(F.size("p")).alias("hi")).first()
    if width["lo"] != width["hi"]:
        raise ValueError("rows of different lengths")
    out = rows.select(F.col("p")[0].cast("double").cast("int").alias(first), F.posexplode(F.slice("p", 2, F.lit(width["hi"] or 1))).alias("bin", "v"))
    return out.select(first, "bin", F.col("v").cast("double").alias(value))


def column(spark, path: str, value: str = "rr") -> DataFrame:
    """bin, value from one number a line, in the order of the text."""
    return ordered_lines(spark, path).select(F.col("id").cast("int").alias("bin"), F.trim("value").cast("double").alias(value))


def rows_of(spark, path: str, n: int | None = None) -> DataFrame:
    """bin, values: an array of n numbers from each line, in the order of the text; another length is an error."""
    p = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    full = p if n is None else F.when(F.size(p) == n, p).otherwise(F.raise_error(F.lit(f"not {n} columns")).cast("array<double>"))
    return ordered_lines(spark, path).select(F.col("id").cast("int").alias("bin"), full.alias("values"))


def coefficients(spark, path: str, n: int = 7) -> DataFrame:
    """bin, coef (an array of n) from n columns."""
    return rows_of(spark, path, n).withColumnRenamed("values", "coef")


def mu_factor_table(spark, path: str, n_mu: int, max_l: int) -> DataFrame:
    """mu_bin, l, factor from a line for each bin of mu and a column for each even multipole."""
    rows = rows_of(spark, path, max_l // 2 + 1)
    if rows.count() != n_mu:
        raise ValueError(f"{path} has not {n_mu} bins of mu")
    return rows.select(F.col("bin").alias("mu_bin"), F.posexplode("values").alias("k", "factor")).select("mu_bin", (F.col("k") * 2).alias("l"), "factor")


def write_text(spark, path: str, text: str) -> None:
    """One file, on any file system that Spark knows; an existing one is an error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_kernel(spark, path: str, kernel: tuple[np.ndarray, np.ndarray], cell: float) -> None:
    """Offsets of cells and their probabilities, a line each; the cell's size stands in a comment."""
    d, p = kernel
    write_text(spark, path, f"# cell {cell!r}\n" + "".join(f"{x} {y} {z} {float(v)!r}\n" for (x, y, z), v in zip(d.tolist(), p, strict=True)))


def read_kernel(spark, path: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The kernel of a reach; another number of lines is an error."""
    got = rows_of(spark, path, 4).orderBy("bin").toArrow()
    rows = np.array(got.column("values").to_pylist(), float).reshape(-1, 4)
    if len(rows) != (2 * reach + 1) ** 3:
        raise ValueError(f"{len(rows)} lines are no kernel of reach {reach}")
    return rows[:, :3].astype(int), rows[:, 3]


# ---- raw terms -------------------------------------------------------------------------------------------------------
def write_terms(terms: DataFrame, path: str) -> None:
    """Partitioned by term and subsample, never over an earlier run."""
    terms.write.mode("errorifexists").partitionBy("term", "subsample").parquet(path)


def read_terms(spark, path: str, names: list[str] | None = None, samples: int | list[int] | None = None) -> DataFrame:
    """Whole terms, or only some subsamples; both prune folders."""
    from galacov.operators import covariance

    out = spark.read.parquet(path).withColumn("subsample", F.col("subsample").cast("int"))
    out = out if names is None else out.where(F.col("term").isin(*names))
    return covariance.selected(out, samples)


#: A matrix file's name: term, bins, tracers, and the subsample or 'full'.
MATRIX_NAME = re.compile(r"(?P<term>c[2-6]j?)_n(?P<n>\d+)_(?P<inner>[lm]\d+)_(?P<tracers>[\d,]+)_(?P<sample>\d+|full)\.txt$")


def text_matrices(spark, folder: str) -> DataFrame:
    """term, tracers, subsample (null: full), row, col, value of all matrix files below a folder. A file is one row until
    its lines are numbered, so splits cannot part it."""
    files = spark.read.text(f"{folder}/*.txt", wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    pattern = re.sub(r"\?P<\w+>", "", MATRIX_NAME.pattern)
    get = lambda i: F.regexp_extract("file", pattern, i)
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    own = files.where(F.regexp_like("file", F.lit(pattern))).select(get(1).alias("term"), get(4).alias("tracers"), F.expr("try_cast(regexp_extract(file, '_([0-9]+)[.]txt$', 1) as int)").alias("subsample"), F.posexplode(lines).alias("row", "line"))
    cells = own.select("term", "tracers", "subsample", "row", F.posexplode(F.split("line", r"\s+")).alias("col", "v"))
    return cells.select("term", "tracers", "subsample", "row", "col", F.col("v").cast("double").alias("value"))


def write_matrices(terms: DataFrame, folder: str, n_r: int, inner: str, tracers: str = "11,11") -> None:
    """(term, subsample, row, col, value) as one text file for each matrix, named by term, bins, tracers and subsample (null:
    full); c2 by its diagonal. Existing files are errors. As many rows as the matrices have entries come to the driver."""
    got = terms.select("term", "subsample", "row", "col", "value").toPandas()
    n = int(max(got["row"].max(), got["col"].max())) + 1
    for (term, sub), rows in got.groupby(["term", "subsample"], dropna=False):
        own = np.zeros((n, n))
        own[rows["row"], rows["col"]] = rows["value"]
        lines = [[v] for v in np.diag(own)] if term.startswith("c2") else own
        name = f"{term}_n{n_r}_{inner}_{tracers}_{'full' if sub != sub else int(sub)}.txt"
        write_text(terms.sparkSession, f"{folder}/{name}", "".join(" ".join(repr(float(v)) for v in line) + "\n" for line in lines))


# ---- results ---------------------------------------------------------------------------------------------------------
def export_covariance(path: str, cov: np.ndarray, alphas: tuple[float, ...]) -> None:
    np.savetxt(path, cov, header="shot_noise_rescaling = " + ", ".join(f"{a:.10g}" for a in alphas))


def read_covariance(path: str) -> tuple[np.ndarray, tuple[float, ...]]:
    with open(path) as f:
        head = f.readline()
    alphas = tuple(float(x) for x in head.partition("=")[2].split(",")) if head.startswith("#") and "=" in head else ()
    return np.loadtxt(path, ndmin=2), alphas


def reordered(cov: np.ndarray, max_l: int | None = None, tracers: int = 1, cross: bool = False) -> np.ndarray:
    """A result's covariance as it is exported: multipoles outermost where there are some, radial bins inside; of two
    tracers all of (11, 12, 22), or the middle block alone (cross)."""
    blocks = 3 if tracers == 2 else 1
    if cross:
        if tracers != 2:
            raise ValueError("only two tracers have a cross-correlation")
        n = len(cov) // 3
        cov, blocks = cov[n : 2 * n, n : 2 * n], 1
    if max_l is None:
        return cov
    n_l = max_l // 2 + 1
    if max_l % 2 or len(cov) % (blocks * n_l):
        raise ValueError(f"{len(cov)} bins are not whole radial bins of {n_l} even multipoles")
    n_r = len(cov) // blocks // n_l
    order = np.arange(len(cov)).reshape(blocks, n_r, n_l).transpose(0, 2, 1).ravel()
    return cov[np.ix_(order, order)]


def load_result(path: str, max_l: int | None = None, tracers: int = 1, cross: bool = False, tell=print) -> np.ndarray:
    """The covariance of a stored result, reordered; tells the largest eigenvalue of its bias matrix."""
    with np.load(path) as f:
        tell(f"largest eigenvalue of the bias matrix: {np.abs(np.linalg.eigvals(f['full_theory_D_matrix'])).max():.2e}")
        return reordered(f["full_theory_covariance"], max_l, tracers, cross)


def export_result(path: str, out: str, max_l: int | None = None, tracers: int = 1, cross: bool = False, tell=print) -> None:
    """A stored result's covariance as text with its rescaling in the header."""
    export_covariance(out, load_result(path, max_l, tracers, cross, tell), rescalings([path])[0])


def cross_of(path_in: str, path_out: str, max_l: int | None = None) -> None:
    """The middle block of a two-tracer covariance file."""
    cov, alphas = read_covariance(path_in)
    export_covariance(path_out, reordered(cov, max_l, 2, True), alphas)


def rescalings(paths: list[str]) -> list[tuple[float, ...]]:
    """Stored shot-noise rescalings of results."""
    return [tuple(np.atleast_1d(np.load(p)["shot_noise_rescaling"]).tolist()) for p in paths]


def counts_format(files: list[str]) -> str:
    """The one extension of files of counts: npy, h5 or txt (dat); a mixture or another one is an error."""
    kinds = {f.rpartition(".")[2].lower().replace("dat", "txt").replace("hdf5", "h5") for f in files}
    if len(kinds) != 1 or not kinds <= {"npy", "h5", "txt"}:
        raise ValueError(f"no common format of counts: {sorted(kinds)}")
    return kinds.pop()


def counts_table(spark, path: str) -> DataFrame:
    """r_bin, mu_bin, r_lo, r_hi, mu_lo, mu_hi, s, wpairs and other columns of counts: the one form that estimates are read
    in, by the extension (Parquet folders, npy of records, or text with a header)."""
    kind = path.rpartition(".")[2].lower()
    if kind == "npy":
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame.from_records(np.load(path)))
    if kind in ("txt", "dat"):
        return spark.read.option("header", True).option("inferSchema", True).option("sep", " ").csv(path)
    return spark.read.parquet(path)
