"""A run from the command line: python -m galacov -in POINTS -cor XI -output FOLDER [settings of RunConfig]."""

from __future__ import annotations

import contextlib
import logging
import os
import sys
import time
from collections.abc import Iterator

import numpy as np
from pyspark.sql import functions as F

from galacov.functions.interpolation import CorrelationFunction
from galacov.plans import config, run
from galacov.sources import binning, tables

#: Files: catalogs, correlation functions of the tracer pairs, a binning, pair counts, a jackknife covariance and a sample
#: covariance of the data as square text matrices, and where results go.
FILES = ("in", "in2", "cor", "cor12", "cor2", "binfile", "RRbin", "jackcov", "jackcov2", "samplecov", "output")


def logger(path: str | None) -> logging.Logger:
    """Writes to the standard output and, with a path, to a file as well."""
    out = logging.getLogger(f"galacov.run.{path}")
    out.setLevel(logging.INFO)
    out.propagate = False
    for h in list(out.handlers):
        out.removeHandler(h)
    for h in [logging.StreamHandler(sys.stdout), *([logging.FileHandler(path)] if path else [])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        out.addHandler(h)
    return out


@contextlib.contextmanager
def timed(log: logging.Logger, what: str) -> Iterator[None]:
    """Tells how long a step took, also if it failed."""
    began = time.monotonic()
    log.info("%s ...", what)
    try:
        yield
    finally:
        log.info("%s took %.1f s", what, time.monotonic() - began)


def split_arguments(args: list[str]) -> tuple[dict[str, str], list[str]]:
    """Files by name, and the settings that are left."""
    files, rest, at = {}, [], 0
    while at < len(args):
        name = args[at].lstrip("-")
        if name in FILES:
            files[name], at = args[at + 1], at + 2
        else:
            rest.append(args[at])
            at += 1
    for need in ("in", "cor", "output"):
        if need not in files:
            raise ValueError(f"-{need} is missing")
    return files, rest


def correlation(spark, path: str) -> CorrelationFunction:
    rows = tables.xi_table(spark, path).orderBy("s", "mu").collect()  # a row a node
    r, mu = sorted({x["s"] for x in rows}), sorted({x["mu"] for x in rows})
    return CorrelationFunction(np.array(r), np.array(mu), np.array([x["xi"] for x in rows]).reshape(len(r), len(mu)))


def main(args: list[str], spark=None) -> str:
    """Runs and returns the path of the stored result."""
    files, rest = split_arguments(args)
    os.makedirs(files["output"], exist_ok=True)
    log = logger(os.path.join(files["output"], "log.txt"))
    own = spark is None
    if own:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("galacov").getOrCreate()
    try:
        settings = config.parse(rest)
        if "binfile" in files:
            edges = binning.edges(binning.read(spark, files["binfile"]))
            settings = config.replaced(settings, edges)
        log.info("settings: %s", settings)
        with timed(log, "reading catalogs"):
            points = tables.particles(spark, files["in"], settings.rescale)
            second = tables.particles(spark, files["in2"], settings.rescale) if "in2" in files else None
            log.info("%d points%s", points.count(), "" if second is None else f" and {second.count()}")
        xi = correlation(spark, files["cor"])
        if second is not None:
            xi = {(1, 1): xi, (1, 2): correlation(spark, files["cor12"]), (2, 2): correlation(spark, files["cor2"])}
        rr = tables.column(spark, files["RRbin"]) if "RRbin" in files else None
        matrix = lambda name: np.loadtxt(files[name], ndmin=2) if name in files else None
        jack = matrix("jackcov")
        if second is not None and jack is not None:
            jack = [jack, matrix("jackcov2")]
        with timed(log, "sampling"):
            out = run.run(points if settings.jackknife else points.drop("jack").withColumn("jack", F.lit(0)), xi, settings, rr, jack, matrix("samplecov"), second=second)
        path = os.path.join(files["output"], "covariance.npz")
        out.save(path)
        log.info("rescaling %s, N_eff %.4g; saved %s", out.shot_noise_rescaling, out.N_eff, path)
        return path
    finally:
        for h in list(log.handlers):
            h.close()
            log.removeHandler(h)
        if own:
            spark.stop()
