"""Survey corrections: how far a survey's pair counts are from those of a uniform volume."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galacov.functions import geometry
from galacov.operators import calibration, pairs


#: Points that a task gathers before it takes their hull, and tasks whose hulls are merged in one.
GATHERED, MERGED = 1 << 18, 16


def hull(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct points and the triangles of their convex hull, by quickhull: each point outside is kept by one face that
    sees it. Points in one plane or fewer than four have no triangles."""
    p = np.unique(np.asarray(points, float).reshape(-1, 3), axis=0)
    none = np.zeros((0, 3), int)
    if len(p) < 4:
        return p, none
    q = p - p.mean(axis=0)
    a = int(q[:, 0].argmin())
    b = int(((q - q[a]) ** 2).sum(axis=1).argmax())
    axis = (q[b] - q[a]) / np.linalg.norm(q[b] - q[a])
    c = int(np.linalg.norm(np.cross(q - q[a], axis), axis=1).argmax())
    d = int(np.abs((q - q[a]) @ np.cross(q[b] - q[a], q[c] - q[a])).argmax())
    least = 1e-13 * np.ptp(q, axis=0).max() ** 3
    if abs((q[d] - q[a]) @ np.cross(q[b] - q[a], q[c] - q[a])) <= least:
        return p, none
    inside = q[[a, b, c, d]].mean(axis=0)
    faces: dict[int, tuple] = {}  # corners, normal, offset, the points it keeps
    beside: dict[tuple[int, int], int] = {}  # the face on the left of each edge
    made, todo = 0, []

    def add(corners: list[tuple[int, int, int]], loose: np.ndarray) -> None:
        nonlocal made
        t = np.array(corners)
        n = np.cross(q[t[:, 1]] - q[t[:, 0]], q[t[:, 2]] - q[t[:, 0]])
        at = (n * q[t[:, 0]]).sum(axis=1)
        above = q[loose] @ n.T - at
        best = above.argmax(axis=1)
        best[above[np.arange(len(loose)), best] <= least] = -1
        for k, f in enumerate(corners):
            faces[made] = (f, n[k], at[k], loose[best == k])
            for e in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])):
                beside[e] = made
            todo.append(made)
            made += 1

    def outward(t):
        n = np.cross(q[t[1]] - q[t[0]], q[t[2]] - q[t[0]])
        return t if n @ (q[t[0]] - inside) > 0 else (t[0], t[2], t[1])

    add([outward(t) for t in ((a, b, c), (a, b, d), (a, c, d), (b, c, d))], np.setdiff1d(np.arange(len(q)), [a, b, c, d]))
    while todo:
        first = todo.pop()
        if first not in faces or not len(faces[first][3]):
            continue
        _, n, at, own = faces[first]
        i = int(own[(q[own] @ n).argmax()])
        seen, front, rim = {first}, [first], []
        while front:
            f = faces[front.pop()][0]
            for x, y in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])):
                k = beside[(y, x)]
                if k in seen:
                    continue
                if q[i] @ faces[k][1] - faces[k][2] > least:
                    seen.add(k)
                    front.append(k)
        for k in seen:
            f = faces[k][0]
            rim += [e for e in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])) if beside[(e[1], e[0])] not in seen]
        if len({x for x, _ in rim}) != len(rim):
            raise ArithmeticError("the hull's surface is not closed")
        loose = np.concatenate([faces[k][3] for k in seen])
        for k in seen:
            del faces[k]
        add([(x, y, i) for x, y in rim], loose[loose != i])
    return p, np.array([f[0] for f in faces.values()])


def hull_volume(points: np.ndarray) -> float:
    """Volume of the convex hull of points in space."""
    p, t = hull(points)
    if not len(t):
        return 0.0
    o = p.mean(axis=0)
    return float(np.abs(np.einsum("ij,ij->i", p[t[:, 0]] - o, np.cross(p[t[:, 1]] - o, p[t[:, 2]] - o)).sum()) / 6)


def extremes(points: DataFrame) -> np.ndarray:
    """The vertices of the points' convex hull, all of them: each task keeps those of its own points' hull, and hulls are
    merged some tasks at a time. Points in one plane stay as they are."""
    def run(batches):
        import pyarrow as pa

        kept, new, size = np.zeros((0, 3)), [], 0

        def shrunk():
            p, t = hull(np.concatenate([kept, *new]))
            return p[np.unique(t)] if len(t) else p

        for b in batches:
            new.append(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1))
            size += b.num_rows
            if size >= max(GATHERED, len(kept)):
                kept, new, size = shrunk(), [], 0
        kept = shrunk()
        yield pa.RecordBatch.from_arrays([pa.array(kept[:, i]) for i in range(3)], names=["x", "y", "z"])

    found = points.select("x", "y", "z").mapInArrow(run, "x double, y double, z double")
    parts = found.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // MERGED)
        found = found.repartition(parts).mapInArrow(run, "x double, y double, z double")
    got = found.toArrow()
    return np.stack([got.column(c).to_numpy() for c in "xyz"], axis=1)


def density(points: DataFrame, n_galaxies: float, box: float | None = None) -> dict[str, float]:
    """Volume, number density of galaxies and mean weight."""
    volume = box**3 if box else hull_volume(extremes(points))
    return {"volume": volume, "n": n_galaxies / volume, "w": points.agg(F.avg("w")).first()[0]}


def fitted(counts: DataFrame, bins: pairs.Bins, first: dict[str, float], second: dict[str, float] | None = None, periodic: bool = False) -> DataFrame:
    """r_bin, coef (7) of 1 over RR's share of a uniform volume's; counts: (r_bin, mu_bin, rr). The curve is fitted by radial
    bin; a periodic box has 1. A mean that strays from 1 by more than two
    orders of magnitude is an error."""
    second = second or first
    scale = first["n"] * second["n"] * first["w"] * second["w"] * math.sqrt(first["volume"] * second["volume"])
    spark = counts.sparkSession
    n_r, n_mu = len(bins.edges), bins.n_mu
    rows = []
    if periodic:
        rows = [(r, [v / scale for v in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)]) for r in range(n_r)]
    else:
        rr = np.zeros((n_r, n_mu))
        for row in counts.select("r_bin", "mu_bin", "rr").collect():  # a row a bin
            rr[row["r_bin"], row["mu_bin"]] = row["rr"]
        mu, means = (np.arange(n_mu) + 0.5) / n_mu, []
        for r, (lo, hi) in enumerate(bins.edges):
            phi = scale * 4 * math.pi / 3 * (hi**3 - lo**3) / n_mu / rr[r]
            if not np.isfinite(phi).all():
                raise ValueError(f"radial bin {r} has bins without pairs")
            means.append(np.mean(phi))
            rows.append((r, (calibration.fitted_correction(mu, phi) / scale).tolist()))
        if not 1e-2 < np.mean(means) < 1e2:
            raise ValueError(f"the mean correction is {np.mean(means):.3g}: check counts, volume and weights")
    return spark.createDataFrame([(r, list(map(float, c))) for r, c in rows], "r_bin int, coef array<double>")


def evaluated(points: DataFrame, coef: DataFrame) -> DataFrame:
    """phi of (r_bin, mu) rows; coef has a row for each radial bin."""
    return points.join(F.broadcast(coef), "r_bin").withColumn("phi", geometry.survey_correction(F.col("mu"), F.col("coef"))).drop("coef")


def three_point_model(spark, bins: pairs.Bins, n: float, w: float, volume: float) -> DataFrame:
    """r1, r2, mu_bin, model: triple counts of a uniform volume, n^3 w^3 V v1 v2 dmu / 2 over the total cosine range 2."""
    edges = [(i, float(4 * math.pi / 3 * (hi**3 - lo**3))) for i, (lo, hi) in enumerate(bins.edges)]
    one = spark.createDataFrame(edges, "r1 int, v1 double")
    two = spark.createDataFrame(edges, "r2 int, v2 double")
    mu = spark.range(bins.n_mu).select(F.col("id").cast("int").alias("mu_bin"))
    k = F.lit(n**3 * w**3 * volume / bins.n_mu)
    return one.join(two).join(mu).select("r1", "r2", "mu_bin", (F.col("v1") * F.col("v2") * k).alias("model"))  # bins x bins x bins
